"""Each operator against a brute-force version on small rows with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, decontam, fingerprints, idstore, langid, linededup, lm, simhash, substring, toxicity
from millrace.llm.graph import components
from millrace.llm.shared import scratch

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "doc_id long, text string, lang string, rid long, g string"
RNG = random.Random(5)
WORDS = ["ab", "Cd", "é", "fgh", "ij.", "k", "l'm", "no", "12", "p,", "qrs", "tuv"]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = sentence(80)
TEXTS = [None, "", " ", "one", BASE, BASE, BASE + " tail", "head " + BASE, sentence(30), "  two  spaces \n\n lines", "x" * 5000, sentence(4000), "İ stanbul ÇÀ", "a b"]
ROWS = [(i, t, "l", 0, "z") for i, t in enumerate(TEXTS)] + [(3, "one", "l", 0, "z"), (None, BASE, None, None, None), (3, "other", "l", 0, "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def encoding():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_matches_the_library_and_round_trips(docs, empty):
    path, enc = encoding()
    got = rows(bpe.roundtrip(docs, path, P.PATTERN).select("doc_id", "ids", "decoded"))
    want = sorted(((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ROWS), key=repr)
    assert [(a, list(b), bytes(c)) for a, b, c in got] == [(a, b, c) for a, b, c in want] or sorted(map(repr, [(a, list(b), bytes(c)) for a, b, c in got])) == sorted(map(repr, want))
    assert bpe.roundtrip(empty, path, P.PATTERN).count() == 0


def test_bpe_decodes_ids_that_are_not_utf8(spark):
    path, enc = encoding()
    ids = enc.encode_ordinary("é中")
    cut = spark.createDataFrame([([i],) for i in ids] + [(None,)], "ids array<int>")
    assert [bytes(r[0]) for r in cut.select(bpe.decode(F.col("ids"), path)).collect()] == [enc.decode_bytes([i]) for i in ids] + [b""]


@pytest.mark.parametrize("seed", range(30))
def test_safe_cuts_keep_ids(seed):
    _, enc = encoding()
    r = random.Random(seed)
    text = "".join(r.choice([" ", "  ", "\n", "a", "b1", "'s", "é", ".", "\t", "\x85", " x"]) for _ in range(300))
    parts = bpe.safe_cuts(text, r.randint(1, 40))
    assert "".join(parts) == text
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(20))
def test_elias_fano(seed):
    r = np.random.default_rng(seed)
    values = np.sort(r.integers(0, 10 ** r.integers(1, 7), r.integers(1, 3000)))
    ef = idstore.EliasFano.load(idstore.EliasFano.of(values).dump())
    assert ef.values().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()
    assert len(ef.dump()) <= 22 + len(values) * (2.5 + max(0, np.log2(max(1, values[-1] / len(values))))) / 8 + 16


def test_id_store(spark, docs, empty):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = scratch(spark, "test")
    idstore.write_store(docs, path, P.path("byte_bpe_50k.json"), 2, 50257)
    got = sorted((r.start, r.doc_id, bytes(r.ids)) for r in idstore.read_store(spark, path).collect())
    start, want = 0, []
    for i, t in sorted(((i, t) for i, t, *_ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((start, i, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    path = scratch(spark, "test")
    idstore.write_store(empty, path, P.path("byte_bpe_50k.json"), 2, 50257)
    assert idstore.read_store(spark, path).count() == 0


def test_pieces_equal_whole_texts():
    own = idstore.Pieces(P.path("byte_bpe_50k.json"), "<u4")
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(" \n\tab'1.é  \x1c\x85") for _ in range(r.randint(0, 9)))
        assert own.encode(text) == own.whole(text), repr(text)


def test_added_tokens_are_coded_as_by_the_library():
    own, tok = idstore.Pieces(P.path("byte_bpe_50k.json"), "<u4"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    for text in ["a <|endoftext|> b", *(f"x {t}y\nz {t}" for t in added), "a <|endof text|> b"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def brute_print(text, n):
    w = (text or "").encode().translate(LOWER).split()
    terms = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    import xxhash

    hs = [xxhash.xxh64_intdigest(t, 42) for t in terms]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints, ids, linked):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if linked(prints[i], prints[j]):
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(i)
    return [min((ids[j] for j in groups[find(i)] if ids[j] is not None), default=None) for i in range(len(prints))]


def test_simhash_groups(docs, empty):
    prints = [brute_print(t, 3) for _, t, *_ in ROWS]
    want = brute_groups(prints, [r[0] for r in ROWS], lambda a, b: (a ^ b).bit_count() <= 2)
    got = simhash.near_groups(docs)
    assert rows(got) == sorted(((r[0], p - (1 << 64) if p >> 63 else p, c) for r, p, c in zip(ROWS, prints, want)), key=repr)
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("radius,segments,run", [(2, 3, 4096), (2, 3, 2), (3, 4, 4096), (3, 4, 5), (8, 3, 4096), (8, 3, 20), (1, 2, 4096)])
def test_pigeonring_links_lose_no_pair(spark, monkeypatch, radius, segments, run):
    monkeypatch.setattr(simhash, "RUN", run)
    r = random.Random(radius)
    prints = [r.getrandbits(64) for _ in range(60)]
    for p in prints[:20]:
        for _ in range(6):
            x = p
            for b in r.sample(range(64), r.randint(1, radius + 2)):
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = components(simhash.links(spark.createDataFrame([(p,) for p in [*signed, None]], "fp long"), radius, segments))
    own = {n: c for n, c in got.collect()}
    want = brute_groups(prints, signed, lambda a, b: (a ^ b).bit_count() <= radius)
    assert [own.get(p, p) for p in signed] == want


def test_verified_groups_keep_one(spark, empty, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    r = random.Random(8)
    base = [[f"w{r.randrange(500)}" for _ in range(r.randint(1, 120))] for _ in range(12)]
    pairs = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(60):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"n{r.randrange(99)}"
        pairs.append((100 + i, " ".join(w)))
    pairs += [(300, None), (301, ""), (302, " "), (None, pairs[0][1]), (5, pairs[5][1]), (5, "another text of that id")]
    texts = sorted({t for _, t in pairs if t is not None})
    prints = [brute_print(t, 3) for t in texts]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 8 and simhash.jaccard(sets[i], sets[j]) >= 0.8:
            root[find(i)] = find(j)
    groups = {}
    for i, t in pairs:
        g = find(texts.index(t)) if t is not None else find(texts.index(""))
        groups.setdefault(g, set()).add((i, t))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in pairs], "doc_id long, text string, text_key int, keep_id int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = [(x.doc_id, x.text) for x in kept.collect()]
    assert len(got) == len(groups)
    for g in groups.values():
        own = [x for x in got if x in g]
        least = min(g, key=lambda x: (x[0] is not None, x[0] or 0))[0]
        assert [x[0] for x in own] == [least]
    assert simhash.keep_one(empty).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5000, 5000), (7000, None), (1000, 1001)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edited_texts_and_next_documents(spark, docs, empty):
    base = [(i, t) for i, t, *_ in ROWS]
    order = sorted(base, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is not None, x[1] or ""))
    want = []
    for (i, t), (_, x) in zip(order, order[1:] + order[:1]):
        t, x = t or "", x or ""
        e = t[: len(t) - len(t) // 3] + x[: len(t) // 3]
        a, b, c = fingerprints.fingerprints([t.encode(), e.encode(), x.encode()])
        near = [1 - sum(int(p ^ q).bit_count() for p, q in zip(a, y)) / 128 for y in (b, c)]
        want.append((i, len(t), e, fingerprints.hexed(np.array([a]))[0], fingerprints.hexed(np.array([b]))[0], *near))
    assert rows(fingerprints.edited_pairs(docs)) == sorted(want, key=repr)
    assert fingerprints.edited_pairs(empty).count() == 0
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    assert fingerprints.edited_pairs(one).first().edited == "abcdab"
    nulls = spark.createDataFrame([(None, "abcdef"), (None, "ghi")], "doc_id long, text string")
    assert sorted(r.edited for r in fingerprints.edited_pairs(nulls).collect()) == ["abcdgh", "gha"]


def test_next_of_the_row_before_null_ids(spark):
    few = spark.createDataFrame([(1, "abcdef"), (2, "ghi"), (3, "jkl"), (None, "mnopqr")], "doc_id long, text string")
    got = {r.doc_id: r.edited for r in fingerprints.edited_pairs(few).collect()}
    assert got == {3: "jkg", 2: "gha", 1: "abcdmn", None: "mnopjk"}


@pytest.mark.parametrize("radius,key_blocks", [(0, 1), (3, 1), (3, 2)])
def test_permuted_tables_find_all_near_fingerprints(spark, monkeypatch, radius, key_blocks):
    r = random.Random(radius)
    prints = [r.getrandbits(128) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in r.sample(range(128), r.randint(1, 5))) for p in prints for _ in range(3)]
    hexes = sorted({f"{p:032x}" for p in prints})
    got = {(a, b, d) for a, b, d in fingerprints.near(spark.createDataFrame([(h,) for h in [*hexes, hexes[0], None]], "fingerprint string"), radius, key_blocks=key_blocks).collect()}
    want = {(a, b, d) for a, b in itertools.combinations(hexes, 2) if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius}
    assert got == want
    some = [h for i, h in enumerate([*hexes, hexes[0]]) if i % 7 == 0] + ["f" * 32]
    df, asked = (spark.createDataFrame([(h,) for h in x], "fingerprint string") for x in ([*hexes, hexes[0], None], [*some, None]))
    monkeypatch.setattr(fingerprints, "RUN", 3 * radius + 2)
    counts = dict(map(tuple, fingerprints.near_counts(df, asked, radius, key_blocks=key_blocks).collect()))
    assert counts == {q: sum((int(q, 16) ^ int(h, 16)).bit_count() <= radius for h in [*hexes, hexes[0]]) for q in set(some)}


def test_logits_beyond_float32():
    z = np.array([[500.0, 0.0, 1.0], [-400.0, -401.0, -400.0], [1.0, 2.0, 3.0]], np.float32)
    want = np.exp(z.astype(np.float64) - z.max(1, keepdims=True))
    e, total = lm._exp(z)
    assert np.allclose(e / total[:, None], want / want.sum(1, keepdims=True), atol=1e-6) and np.isfinite(np.log(total)).all()


def test_equal_and_wordless_fingerprints(docs):
    got = {(r.text, r.f) for r in docs.select("text", fingerprints.fingerprint(F.col("text")).alias("f")).collect()}
    assert len({f for t, f in got if t == BASE}) == 1
    assert {f for t, f in got if not (t or "").strip()} == {"0" * 32}


def brute_removed(pairs, window):
    words = [(t or "").encode().split() for _, t in pairs]
    low = {}
    for (i, _), w in zip(pairs, words):
        for s in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[s : s + window])
            low[k] = min(low.get(k, i), i)
    out = []
    for (i, _), w in zip(pairs, words):
        gone = set()
        for s in range(len(w) - window + 1) if i is not None else ():
            if low[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,gram,hot", [(50, 10, 2048), (50, 10, 1), (6, 2, 3), (6, 6, 2048), (5, 1, 2)])
def test_substring_dedup(spark, docs, empty, window, gram, hot):
    r = random.Random(window)
    shared = [" ".join(r.choice("abcdef") for _ in range(r.randint(4, 90))) for _ in range(6)]
    extra = [(100 + i, " ".join(r.choice([*shared, "u v w x", "y\n z"]) for _ in range(r.randint(1, 5))), "l", 0, "z") for i in range(40)]
    both = ROWS + extra
    df = spark.createDataFrame(both, SCHEMA)
    assert rows(substring.removed(df, window=window, gram=gram, hot=hot)) == brute_removed([r[:2] for r in both], window)
    assert substring.removed(empty, window=window).count() == 0


@pytest.mark.parametrize("hot", [2048, 1])
def test_substring_tells_regular_words_and_passages_apart(spark, hot):
    a, b = "a", "b"
    for _ in range(10):  # regular sequences, on which hashes by powers modulo 2^64 meet
        a, b = a + b, b + a
    p, q = ["x"], ["y"]
    for _ in range(6):
        p, q = p + q, q + p
    around = [f"w{i}" for i in range(30)]
    pairs = [(1, " ".join([*around, a, *around])), (2, " ".join([*around, b, *around])), (3, " ".join([*around[:13], *p, *around[:13]])), (4, " ".join([*around[:13], *q, *around[:13]]))]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = rows(substring.removed(df, hot=hot))
    assert got == brute_removed(pairs, 50) and [r[2] for r in got] == [0, 0, 0, 0]


@pytest.mark.parametrize("seed", range(20))
def test_suffix_automaton_statistics(seed):
    r = random.Random(seed)
    refs = [[r.choice("ab") for _ in range(r.randint(0, 30))] for _ in range(4)]
    text = [r.choice("abc") for _ in range(60)]
    sa = substring.SuffixAutomaton()
    for x in refs:
        sa.add(x)
    pieces = {tuple(x[i:j]) for x in refs for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    want = [max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in pieces)) for i in range(len(text))]
    assert list(sa.matches(text)) == want


def plain_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_decontamination(spark, docs, empty):
    base = plain_words(BASE)
    items = [(1, " ".join(base[5:17])), (2, BASE), (3, "One"), (4, None), (5, "..."), (None, BASE), (6, " ".join(base[5:17])), (7, "ab cd zz"), (10, " ".join(base[20:29]))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rid long")
    windows = {}
    for i, t in items:
        w = plain_words(t)
        if i is None or not w:
            continue
        n = min(10, len(w))
        for s in range(len(w) - n + 1):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    want = []
    for i, t, *_ in ROWS:
        w, hit, found = plain_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= own
        want.append((i, len(w), len(hit), sorted(map(str, found))))
    got = decontam.report(docs, bench).select("doc_id", "n_words", "n_hit", "items")
    assert rows(got) == sorted(want, key=repr)
    assert any(x[2] for x in want)
    assert decontam.report(empty, bench).count() == 0
    assert {r.n_hit for r in decontam.report(docs, bench.limit(0)).collect()} == {0}


def test_decontamination_plan_is_native(docs):
    made = decontam.report(docs, docs.withColumnRenamed("doc_id", "item_id"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()


def line_brute(pairs):
    nodes, occ = {}, []
    for i, t in sorted(set(pairs), key=lambda x: (x[0] is not None, x[0] or 0)):
        for p, line in enumerate((t or "").split("\n")):
            if f := linededup.normal(line):
                nodes.setdefault(f, len(nodes))
                occ.append((i, t, p, f))
    names = list(nodes)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(1, len(names)):
        for j in range(i):
            if linededup.similar(names[i], names[j]):
                root[find(i)] = find(j)
    seen, drop = set(), {}
    for i, t, p, f in occ:
        if (g := find(nodes[f])) in seen:
            drop.setdefault((i, t), set()).add(p)
        seen.add(g)
    return sorted(((i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in drop.get((i, t), ()))) for i, t in pairs), key=repr)


def test_line_dedup(spark, empty):
    r = random.Random(9)
    lines = [" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(r.randint(1, 40))) for _ in range(30)]
    lines += [x + " more" for x in lines] + [x.upper() for x in lines[:5]] + ["", " "]
    pairs = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 6)))) for i in range(60)] + [(100, None), (101, ""), (102, "a\n\nb\n"), (3, None)]
    pairs.append(pairs[0])
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in pairs], "doc_id long, text string, rid int, n_lines int, drop int")
    got = linededup.dedup(df)
    assert got.columns == ["doc_id", "text", "rid", "n_lines", "drop", "_n_lines", "n_dropped"]
    assert rows(got.select("doc_id", "text")) == line_brute(pairs)
    assert linededup.dedup(empty).count() == 0


def test_line_dedup_finds_what_fingerprints_miss(spark):
    r = random.Random(12)

    def word():
        return "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))

    pairs = []
    for i in range(60):
        w = [word() for _ in range(r.randint(20, 60))]
        pairs.append((2 * i, " ".join(w)))
        for k in r.sample(range(len(w)), len(w) // 6):
            w[k] = "".join(r.choice("qrstuvwxyz") for _ in w[k])
        pairs.append((2 * i + 1, " ".join(w)))
    for i in range(200, 300, 2):  # short lines: letters changed, added and left out
        a = "".join(r.choice("abcd ") for _ in range(r.randint(5, 27))).strip() + "xyz"
        at = r.randrange(len(a))
        pairs += [(i, a), (i + 1, a[:at] + r.choice(["", "e", "ef"[:1 + len(a) // 10]]) + a[at + 1 :])]
    names = [linededup.normal(t) for _, t in pairs]
    prints = linededup.line_prints([x.encode() for x in names])
    apart = [int(a ^ b) for a, b in zip(prints[0:120:2], prints[1:120:2], strict=True)]
    unmet = [x.bit_count() > 10 or all(x >> k & 0xFFFF for k in (0, 16, 32, 48)) for x in apart]
    assert sum(x and linededup.similar(names[2 * i], names[2 * i + 1]) for i, x in enumerate(unmet)) > 20
    want = brute_groups(names, [i for i, _ in pairs], linededup.similar)
    got = {x.doc_id: x.text for x in linededup.dedup(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert {i for i, t in got.items() if t} == set(want)


def test_large_runs_are_walked(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SMALL", 2)
    long = " ".join(f"word{i}" for i in range(60))
    pairs = [(i, long.replace(f"word{i % 50} ", f"other{i} ")) for i in range(60)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert rows(linededup.dedup(df).select("doc_id", "text")) == line_brute(pairs)


def test_large_runs_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(linededup, "RUN", 5)
    monkeypatch.setattr(linededup, "CHUNK", 7)
    long = " ".join(f"word{i}" for i in range(60))
    pairs = [(i, long.replace(f"word{i % 50} ", f"other{i} ")) for i in range(60)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert rows(linededup.dedup(df).select("doc_id", "text")) == line_brute(pairs)


@pytest.mark.parametrize("seed", range(12))
def test_one_line_against_many(monkeypatch, seed):
    monkeypatch.setattr(linededup, "FEW", 1)
    r = random.Random(seed)
    base = "".join(r.choice("abcé ") for _ in range([1, 40, 63, 64, 65, 128, 130, 300, 500, 700, 20, 90][seed])) or "a"
    lines = [base]
    for _ in range(60):
        x = list(base)
        for _ in range(r.randrange(len(base) // 2 + 2)):
            at = r.randrange(len(x) + 1)
            x[at : at + r.randint(0, 1)] = r.choice(["", "x", "a"])
        lines.append("".join(x) or "b")
    most = [r.randrange(len(base) + 2) for _ in lines[1:]]
    assert linededup.near([(base, x) for x in lines[1:]], most).tolist() == [linededup.within(base, x, m) for x, m in zip(lines[1:], most, strict=True)]


@pytest.mark.parametrize("seed", range(4))
def test_cells_together_equal_cells_alone(seed):
    r = random.Random(seed)
    cells = []
    for _ in range(30):
        words = [f"{r.choice('abcé')}word{r.randrange(60)}" for _ in range(r.choice([3, 12, 60]))]
        lines = [" ".join(r.choice("xyz") if r.random() < r.choice([0.05, 0.3]) else w for w in words) for _ in range(r.randrange(2, 9))]
        cells.append((lines, [[r.randrange(3), 7] for _ in lines], None))
    cells.append((cells[0][0], cells[0][1], 7))
    found = linededup.cell_links(cells, 0.8)
    assert found == [linededup.cell_links([c], 0.8)[0] for c in cells] and any(found)


@pytest.mark.parametrize("seed", range(6))
def test_lines_of_any_lengths_go_on_together(seed):
    r = random.Random(seed)
    pairs, most = [], []
    for n in [1, 63, 64, 65, 130, 200, 300] * 4:
        a = "".join(r.choice("abcé ") for _ in range(n))
        b = "".join(x for c in a for x in r.choices([c, "x", "", c + "y"], [1 - 0.15 * (seed % 6), 0.15, 0.15, 0.15])[0]) or "b"
        a, b = sorted((a, b), key=len)
        pairs.append((a, b))
        most.append(len(b) - len(a) + r.randrange(len(b) // 2 + 1))
    got = linededup.columns_at_once(pairs, np.array(most))
    assert got.tolist() == [linededup.columns(b, a, m) for (a, b), m in zip(pairs, most, strict=True)]


def test_unlike_lines_of_a_cell_are_compared_in_few_steps(monkeypatch):
    steps, near = [], linededup.near
    monkeypatch.setattr(linededup, "near", lambda pairs, most: steps.append(len(pairs)) or near(pairs, most))
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(7)) for _ in range(12)]
    lines = [" ".join(r.sample(words, 12)) for _ in range(60)]  # all minima are shared
    lines += [x.replace(words[0], "other") for x in lines[::3]]
    keys = [[r.randrange(3), 5] for _ in lines]
    for only in (None, 5):
        steps.clear()
        (links,) = linededup.cell_links([(lines, keys, only)], 0.8)
        met = [(i, j) for j in range(len(lines)) for i in range(j) if only is None or keys[i][0] != keys[j][0]]
        want, got = list(range(len(lines))), list(range(len(lines)))
        for root, pairs in ((want, [p for p in met if linededup.similar(lines[p[0]], lines[p[1]])]), (got, links)):
            for i, j in pairs:
                i, j = root[i], root[j]
                root[:] = [min(i, j) if x in (i, j) else x for x in root]
        assert got == want and len(set(want)) > 20 and sum(steps) > 1000 and len(steps) <= 8


@pytest.mark.parametrize("seed", range(20))
def test_edit_distance_of_long_lines(monkeypatch, seed):
    monkeypatch.setattr(linededup, "PAUSE", 1 + seed % 5)
    r = random.Random(seed)
    a = "".join(r.choice("abcdé ") for _ in range(r.randint(30, 150)))
    b = "".join(x for c in a for x in r.choices([c, "x", "", c + "y"], [1 - 0.1 * (seed % 6), 0.1, 0.1, 0.1])[0])
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, e = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(e[j] + 1, d[j - 1] + 1, e[j - 1] + (x != y)))
    for k in {0, d[-1] - 1, d[-1], d[-1] + 1, len(a) // 5}:
        assert linededup.within(a, b, k) == (d[-1] <= k) == linededup.columns(a, b, k)


@pytest.mark.parametrize("seed", range(50))
def test_edit_distance(seed):
    r = random.Random(seed)
    a = "".join(r.choice("abc") for _ in range(r.randint(0, 20)))
    b = "".join(r.choice("abc") for _ in range(r.randint(0, 20))) if seed % 2 else a[:5] + "x" + a[7:]
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, e = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(e[j] + 1, d[j - 1] + 1, e[j - 1] + (x != y)))
    assert [linededup.within(a, b, k) for k in range(21)] == [d[-1] <= k for k in range(21)]


def test_lm_base_and_total_probability(spark, docs, empty):
    import math

    got = lm.fit_and_score(docs.withColumn("held_out", F.lit(1)), F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False)))
    toks = [(i, (t or "").encode().translate(LOWER).split() + [None]) for i, t, *_ in ROWS]
    counts = Counter()
    for i, w in toks:
        if i is None or i % 5 != 1:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = [(i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in toks]
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert lm.fit_and_score(empty, F.lit(False)).count() == 0
    assert {r.base_score for r in lm.fit_and_score(docs, F.lit(True)).collect()} == {0.0}


def test_lm_is_a_distribution_and_learns(spark):
    r = random.Random(1)
    text = lambda: " ".join(r.choice(["a b c d", "x y z w"]) for _ in range(30))
    df = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    counts = lm.count_words(df)
    m = lm.train(df, lm.untrained(counts))
    lexicon, end = lm._lexicon(m)
    got = lm.fit_and_score(df, F.col("doc_id") % 4 == 0).where("doc_id % 4 = 0").collect()
    assert all(x.score > x.base_score for x in got)
    # after a fixed beginning the probabilities of all known words and of one unknown word a rare class sum to one
    head = [lexicon[b"a"], lexicon[b"b"]]
    every = [*range(len(m.words)), *range(lm.KNOWN, lm.KNOWN + lm.RARE)]
    total = sum(10 ** lm.log_probabilities(m, np.array([*head, c]), np.array([3]))[-1] for c in every)
    assert abs(total - 1) < 1e-3


def test_language_identification(spark, empty):
    r = random.Random(2)
    syl = {"xx": ["ba", "ko", "mi"], "yy": ["sch", "ung", "tz"], "zz": ["eau", "oix", "é"]}
    text = lambda k: " ".join("".join(r.choice(syl[k]) for _ in range(3)) for _ in range(20))
    data = [(i, text(k := r.choice(list(syl))), k, "s") for i in range(300)]
    more = [(1000, None, "xx", "s"), (1001, "12 34 !!", "xx", "s"), (1002, "", None, "s"), (1003, text("yy") * 300, None, "s"), (None, text("xx"), "xx", "s")]
    df = spark.createDataFrame(data + more, "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(df.where("doc_id % 4 != 2"))
    got = {r.doc_id: r.p for r in df.select("doc_id", langid.predict(spark, model, F.col("text")).alias("p")).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k, _ in data if i % 4 == 2]) > 0.97
    assert [tuple(got[i]) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert got[1003].lang_pred == "yy" and got[None].lang_pred == "xx"
    assert all(0 <= p.score <= 1 for p in got.values())
    assert not any(got[i].rejected for i, *_ in data)
    assert langid.fit(empty) is None
    assert {r.p.lang_pred for r in df.select(langid.predict(spark, None, F.col("text")).alias("p")).collect()} == {"und"}


def test_toxicity_held_out_and_edge_rows(spark, empty):
    r = random.Random(4)
    insults = ["vilezz", "vilexx", "grotk"]
    clean = [f"w{i}" for i in range(300)]

    def text(toxic):
        w = [r.choice(clean) for _ in range(30)]
        if toxic:
            w[r.randrange(30)] = r.choice(insults)
            w[r.randrange(30)] = r.choice(insults)
        return " ".join(w)

    data = [(i, text(y := int(r.random() < 0.3)), y) for i in range(900)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in data] + [(5000, None, "s"), (5001, "", "s")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(5000, None), (None, 1), (5001, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id % 3 != 1"), labels.where("doc_id % 3 != 1"))
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(spark, model, F.col("text")).alias("s")).collect()}
    held = [(got[i] >= 0.7, y) for i, _, y in data if i % 3 == 1]
    assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.02
    assert 0 <= got[5000] == got[5001] < 0.5
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r.s for r in docs.select(toxicity.score(spark, None, F.col("text")).alias("s")).collect()} == {0.0}


def test_counterfactual_penalty_takes_weight_off_group_names():
    r = random.Random(6)
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        w = [f"w{r.randrange(100)}" for _ in range(10)] + (["vilezz"] if toxic and r.random() < 0.6 else [])
        if r.random() < (0.7 if toxic else 0.05):
            w.append("muslims")
        texts.append(" ".join(w))
        labels.append(int(toxic))
    feats = [toxicity.features(t) for t in texts]
    swapped = {i: toxicity.features(s) for i, t in enumerate(texts) if (s := toxicity.swap_identities(t))}
    neutral = ["w1 w2 w3 muslims w4"]
    biased = toxicity.train(feats, np.array(labels), {}).scores(neutral)[0]
    fair = toxicity.train(feats, np.array(labels), swapped, 20.0).scores(neutral)[0]
    assert fair < biased - 0.1 and fair < 0.5
    assert toxicity.swap_identities("nobody here") is None
    assert "christians" in toxicity.swap_identities("The Muslims came")
