"""Each operator against a brute-force version on small tables with odd rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RNG = np.random.default_rng(5)
VOCAB = ["".join(RNG.choice(list("abcdefghiéß"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


def corpus():
    shared = prose(60)
    base = prose(120)
    texts = [None, "", "  \n\t ", "one", "Two Words", "The The The " * 120, "x" * 900, shared, base, base, base.upper(), base.replace(" ", "  "), base + " " + prose(1)]
    texts += [prose(30) + " " + shared + "\n" + prose(25) for _ in range(6)]
    texts += [" ".join(w if k != j else "changed" for k, w in enumerate(base.split())) for j in range(5, 60, 11)]
    texts += [prose(int(n)) for n in RNG.integers(1, 400, 20)]
    texts += [prose(9000), "All rights reserved. " * 3 + prose(10), "don't we'll it's 'S 12 <|endoftext|> Σας"]
    rows = [(k, t, None if k % 7 == 0 else "aa", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[9], (None, prose(50), None, None, None), (None, None, None, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumn("key", F.lit(1)).withColumn("score", F.lit("x")).withColumn("fp", F.lit(2))


def bag(rows):
    return Counter(tuple(r) for r in rows)


def windows_twice(units, width):
    seen = Counter(tuple(u[k : k + width]) for u in units for k in range(len(u) - width + 1))
    for u in units:
        hit = np.zeros(len(u), dtype=bool)
        for k in range(len(u) - width + 1):
            if seen[tuple(u[k : k + width])] > 1:
                hit[k : k + width] = True
        yield u, hit


def thue_morse(n):
    """Two strings whose polynomial hashes modulo 2**64 are equal for every base."""
    x = "ab"
    while len(x) < n:
        x += x.translate({97: "b", 98: "a"})
    return x, x.translate({97: "b", 98: "a"})


def test_suffix_repeats(spark, docs, monkeypatch):
    from weft.llm import repeats
    from weft.llm.suffix_array import digest, suffix_repeats

    want = []
    for r, (u, hit) in zip(ROWS, windows_twice([(r[1] or "").encode() for r in ROWS], 200)):
        kept = bytes(np.frombuffer(u, np.uint8)[~hit])
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        want.append((r[0], len(u), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    assert bag(digest(suffix_repeats(docs)).collect()) == bag(want)
    for crowded in (1 << 12, 64):  # some or all hashes are split, once or twice
        monkeypatch.setattr(repeats, "SHARD", crowded)
        assert bag(digest(suffix_repeats(docs)).collect()) == bag(want)
    x, y = thue_morse(4096)
    apart = spark.createDataFrame([(1, x[:1024] + "-"), (2, y[:1024] + "+")], "doc_id bigint, text string")
    by = {r[0]: r[1:] for r in zip((1, 2), *zip(*[(int(h.sum()),) for _, h in windows_twice([r.text.encode() for r in apart.collect()], 200)]))}
    assert {r.doc_id: (r.n_removed,) for r in digest(suffix_repeats(apart)).collect()} == by


def test_suffix_array_by_brute_force():
    from weft.llm.suffix_array import refine

    raw = np.frombuffer(b"abracadabra" * 9 + b"banana" * 7 + bytes(RNG.integers(97, 99, 400).astype(np.uint8)), np.uint8)
    for width in (6, 13, 40):
        position, pointer = refine(raw, width)
        by = defaultdict(list)
        for k in range(len(raw) - width + 1):
            by[raw[k : k + width].tobytes()].append(k)
        assert position.tolist() == sorted(position.tolist(), key=lambda p: (raw[p : p + width].tobytes(), position.tolist().index(p)))
        want = sorted(v for v in by.values() if len(v) > 1)
        got = defaultdict(list)
        for p, q in zip(position.tolist(), pointer.tolist()):
            got[q].append(p)
        assert sorted(sorted(v) for v in got.values()) == want


def test_block_repeats(spark, docs, monkeypatch):
    from weft.llm import repeats
    from weft.llm.block_anchors import block_repeats, digest

    want = []
    for r, (u, hit) in zip(ROWS, windows_twice([(r[1] or "").encode().split() for r in ROWS], 35)):
        want.append((r[0], len(u), int(hit.sum()), hashlib.sha256(b" ".join(w for w, h in zip(u, hit) if not h)).hexdigest()))
    assert bag(digest(block_repeats(docs)).collect()) == bag(want)
    for crowded in (1 << 12, 64):
        monkeypatch.setattr(repeats, "SHARD", crowded)
        assert bag(digest(block_repeats(docs)).collect()) == bag(want)
    x, y = thue_morse(4096)
    common = " ".join(f"w{k}" for k in range(34))
    apart = spark.createDataFrame([(1, f"{common} {x}"), (2, f"{common} {y}")], "doc_id bigint, text string")
    assert [r.n_removed for r in digest(block_repeats(apart)).collect()] == [0, 0]


def test_anchors_by_brute_force(monkeypatch):
    from weft.llm import block_anchors
    from weft.llm.repeats import Words

    texts = [" ".join(RNG.choice(["a", "b", "cc"], int(n))) for n in RNG.integers(7, 60, 30)] + ["a " * 50, "a b " * 40]
    sizes = np.cumsum([0, *(len(t.encode()) for t in texts)])
    units = Words(np.frombuffer("".join(texts).encode(), np.uint8), sizes)
    for chance in (False, True):
        if chance:  # every block hash is the same
            monkeypatch.setattr(block_anchors, "between", lambda sums, starts, ends, seed: np.zeros(len(starts), np.uint64))
        for width in (5, 6, 7):
            got = block_anchors.repeated(units, np.diff(units.first) - width + 1, width)
            seen = Counter(tuple(w[k : k + width]) for t in texts for w in [t.split()] for k in range(len(w) - width + 1))
            want = [seen[tuple(w[k : k + width])] > 1 for t in texts for w in [t.split()] for k in range(len(w))]
            assert got.tolist() == want


def test_words_that_hashes_confuse(spark, monkeypatch):
    from tokenizers import Tokenizer

    from weft.llm import text, wordpieces
    from weft.llm.decontaminate import contaminated, digest

    x, y = thue_morse(4096)
    path = public_tokenizers.path("word_bpe_49k.json")
    slow = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(1, y), (2, x)], "doc_id bigint, text string")
    bench = spark.createDataFrame([("i", x)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in digest(contaminated(docs, bench)).collect()} == {1: 0, 2: 1}
    for _ in range(2):
        assert wordpieces.WordPieces(path).encode([f"{x} {y}", "ab ba ab"])[0].tolist() == slow.encode(f"{x} {y}", add_special_tokens=False).ids
        monkeypatch.setattr(wordpieces, "span_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    raw = np.frombuffer(b"one two one onetwo ", np.uint8)
    starts, ends, _ = text.spans(raw, np.array([0, len(raw)]), ~text.SPACE)
    example, which = text.numbered(raw, starts, ends, np.zeros(4, np.uint64))
    assert which.tolist() == [0, 1, 0, 2] and example.tolist() == [0, 1, 3]


def test_text_without_repeats(docs):
    from weft.llm.suffix_array import without_repeats

    out = without_repeats(docs.where("doc_id is not null")).collect()
    assert out[0].asDict().keys() == dict.fromkeys(docs.columns).keys() and len(out) == sum(r[0] is not None for r in ROWS)
    by = {r.doc_id: r.text for r in out}
    assert by[0] is None and by[1] == "" and by[9] == "" and by[3] == "one"


def fingerprints(width):
    for r in ROWS:
        w = (r[1] or "").encode().lower().split()
        s = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        yield sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(docs):
    from weft.llm.simhash import near_duplicates

    fp = list(fingerprints(3))
    label = list(range(len(fp)))
    for _ in fp:
        label = [min(label[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 2) for i in range(len(fp))]
    low = {g: min((ROWS[i][0] for i in range(len(fp)) if label[i] == g and ROWS[i][0] is not None), default=None) for g in set(label)}
    want = [(r[0], f"{f:016x}", low[g]) for r, f, g in zip(ROWS, fp, label)]
    assert bag(near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()) == bag(want)


def test_tree_loses_no_link(monkeypatch):
    from weft.llm import simhash

    monkeypatch.setattr(simhash, "LEAF", 16)
    base = RNG.integers(0, 1 << 62, 300, dtype=np.uint64)
    near = base.copy()
    for _ in range(2):
        near ^= np.uint64(1) << RNG.integers(0, 64, len(near), dtype=np.uint64)
    x = np.unique(np.concatenate([base, near, np.arange(200, dtype=np.uint64)]))
    a, b = simhash._search(x, x[:0], 2)

    def groups(pairs):
        root = {v: v for v in x.tolist()}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for p, q in pairs:
            root[max(find(p), find(q))] = min(find(p), find(q))
        return {v: find(v) for v in root}

    close = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    assert groups(zip(a.tolist(), b.tolist())) == groups((x[i].item(), x[j].item()) for i, j in zip(*np.nonzero(close)))


def test_near_copies_keep_one(docs):
    from weft.llm.near_copies import without_copies

    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    some = [r for r in ROWS if (r[1] or "").split()]
    sets = [shingles(r[1]) for r in some]
    label = list(range(len(some)))
    alike = [[j for j in range(len(some)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(some))]
    for _ in range(10):
        label = [min(label[j] for j in alike[i]) for i in range(len(some))]
    kept = without_copies(docs).collect()
    assert len(kept) == len(set(label)) + sum(not (r[1] or "").split() for r in ROWS)


def test_near_copies_around_a_shared_passage(spark):
    """Each text is alike to 0.8 with one other and to 0.71 with all others."""
    from weft.llm.near_copies import without_copies

    passage = " ".join(f"p{k}" for k in range(79))
    texts = [" ".join([passage, *(f"s{g}x{k}" for k in range(5)), *(f"o{g}y{side}z{k}" for k in range(10))]) for g in range(150) for side in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in without_copies(docs).select("doc_id").collect()) == list(range(0, 300, 2))


def test_near_copies_in_chains_from_one_centre(spark):
    """Many texts are like the first one; each has another one that is like it and not like the first."""
    from weft.llm.near_copies import without_copies

    base, texts = [f"a{k}" for k in range(104)], []
    for g in range(120):
        own, other = ([f"{c}{g}w{k}" for k in range(11)] for c in "bc")
        texts += [base[:93] + own, other + base[11:93] + own]
    docs = spark.createDataFrame(list(enumerate(map(" ".join, [base, *texts]))), "doc_id bigint, text string")
    assert [r.doc_id for r in without_copies(docs).select("doc_id").collect()] == [0]


def test_near_copies_of_short_texts(spark):
    """Four shingles and the same with a fifth."""
    from weft.llm.near_copies import without_copies

    texts = [" ".join(f"t{g}w{k}" for k in range(n)) for g in range(300) for n in (8, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in without_copies(docs).select("doc_id").collect()) == list(range(0, 600, 2))


def test_decontamination(spark, docs):
    from weft.llm.decontaminate import contaminated, digest, without_hits

    words = [r[1].split() for r in ROWS if r[1] and len(r[1].split()) > 40][:4]
    items = [(1, " ".join(words[0][3:25])), (10, " ".join(words[1][:12]).upper() + "!"), (2, "one"), (3, ""), (4, None), (None, "two words"), (5, "nothing of this kind occurs here at all my dear friend"), (1, " ".join(words[0][3:25])), (6, "the the the the the the the the the the the")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    phrase = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            phrase[tuple(w[k : k + 10])].add(str(i))
    want = []
    for r in ROWS:
        w, hit, found = cut(r[1]), set(), set()
        for n in {len(p) for p in phrase}:
            for k in range(len(w) - n + 1):
                if (own := phrase.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        want.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert bag(digest(contaminated(docs, bench)).collect()) == bag(want)
    clean = without_hits(docs, bench)
    assert clean.columns == docs.columns
    assert digest(contaminated(clean, bench.where("item_id = 2"))).where("contaminated").isEmpty()


def test_index_finds_all():
    from weft.llm.decontaminate import FMIndex

    text = RNG.integers(1, 4, 500)
    text[::97] = 0
    index = FMIndex(text)
    for width in (1, 3, 6):
        for phrase in np.unique(RNG.integers(1, 4, (20, width)), axis=0):
            low, high = index.search(phrase[None, :])
            got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert got == [k for k in range(len(text) - width + 1) if (text[k : k + width] == phrase).all()]


def test_packing(docs):
    from tokenizers import Tokenizer

    from weft.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    slow = Tokenizer.from_file(path)
    want = Counter()
    for r in ROWS:
        ids = np.array([*slow.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[(r[0], k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()))] += 1
    got = pack(docs, path).toPandas().sort_values(["sequence_id", "offset"])
    assert Counter((None if x != x else int(x), *y) for x, *y in got.iloc[:, :5].itertuples(index=False)) == want
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    sums = got.groupby("sequence_id").length.sum()
    assert sums.max() <= 4096 and len(sums) <= -(-sums.sum() // 4096) + 1


def test_plans_use_every_piece():
    from weft.llm.packing import plan

    for counts in ({1: 5}, {4096: 3, 4095: 2, 1: 2}, {int(n): int(c) for n, c in zip(RNG.integers(1, 4097, 500), RNG.integers(1, 90, 500))}, {}):
        used = Counter()
        for pattern, times in plan(dict(counts)):
            assert sum(pattern) <= 4096 and times > 0
            for n in pattern:
                used[n] += times
        assert used == Counter(counts)
        total = sum(n * c for n, c in counts.items())
        assert sum(t for _, t in plan(dict(counts))) <= max(-(-total // 4096), sum(c for n, c in counts.items() if n > 2048)) * 1.03 + 2


@pytest.mark.parametrize("cell", [2048, 24])
def test_near_vectors(spark, monkeypatch, cell):
    from weft.llm import embeddings

    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", 20 if cell == 24 else 2048)
    centres = RNG.normal(size=(40, 12))
    rows = [(k, [float(np.float32(v)) for v in centres[k % 40] + RNG.normal(size=12) * 0.2 * (k % 3)], k % 2) for k in range(200)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, None, 0), (203, [0.0] * 12, 0), (204, rows[0][1], None), (205, [float("nan")] * 12, 0), (206, [], 0), (207, [None, *rows[0][1][1:]], 0), (208, rows[0][1][:5], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("node", F.lit(1))
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    link = defaultdict(set)
    for a in ok:
        for b in ok:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93:
                link[a[0]].add(b[0])
    low = {r[0]: r[0] for r in rows}
    for _ in range(30):
        low = {i: min([low[i], *(low[j] for j in link[i])]) for i in low}
    want = [(r[0], len(link[r[0]]), low[r[0]], low[r[0]] == r[0]) for r in rows]
    assert bag(embeddings.near_vectors(df).collect()) == bag(want)


def test_language(spark):
    from weft.llm.language import fit, infer, languages

    a, b = ["the", "and", "thing", "with"], ["der", "und", "nicht", "schon"]
    mk = lambda v, n: " ".join(RNG.choice(v, n))
    rows = [(k, mk(a if k % 2 else b, 80), "en" if k % 2 else "de") for k in range(40)]
    learned = fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    test = [(1, mk(a, 30), "en"), (2, mk(b, 30), "de"), (3, None, "und"), (4, " 12 !", "und"), (5, "", "und"), (6, mk(a, 300) + " " + mk(b, 150), "en")]
    got = {r.doc_id: r for r in languages(spark.createDataFrame([t[:2] for t in test], "doc_id bigint, text string"), learned).collect()}
    assert {k: r.lang_pred for k, r in got.items()} == {t[0]: t[2] for t in test}
    assert got[6].shares["de"] == pytest.approx(1 / 3, abs=0.05) and set(got[1].shares) == {"en"}
    none = fit(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert languages(spark.createDataFrame([(1, "word")], "doc_id bigint, text string"), none).first().lang_pred == "und"
    share, size = infer(np.ones((0, 3)), np.zeros(0, np.int64), 2)
    assert share.shape == (2, 3)


def test_quality(spark):
    from weft.llm.quality import fit, score

    rows = [(k, prose(60) if k % 2 else " ".join(["spam"] * 40 + ["$$$"] * 9)) for k in range(60)]
    docs = spark.createDataFrame([*rows, (100, None), (101, "")], "doc_id bigint, text string").withColumn("label", F.lit("z"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (50, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in score(docs, fit(docs, labels)).collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in range(40, 60)) and all(0 <= s <= 1 for s in got.values()) and len(got) == 62
    assert score(docs, fit(docs, labels.limit(0))).first().score == 0.5


def test_token_counts(docs):
    import tiktoken

    from weft.llm.token_counts import attribute, token_counts

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = token_counts(docs, path, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], len(encoding.encode_ordinary(r[1] or ""))) for r in ROWS)
    for r in got:
        assert r.n_tokens == r.n_outside + sum(s.n_tokens for s in r.sections)
    sections = np.array([[0, 4], [4, 9], [12, 20]])
    starts, ends = np.array([0, 3, 9, 11, 8, 2]), np.array([3, 6, 11, 13, 14, 19])
    assert attribute(starts, ends, sections, "first").tolist() == [0, 0, -1, 2, 1, 0]
    assert attribute(starts, ends, sections, "last").tolist() == [0, 1, -1, 2, 2, 2]
    assert attribute(starts, ends, sections, "largest").tolist() == [0, 1, -1, 2, 2, 2]


def test_licenses(spark):
    from weft.llm.licenses import TEMPLATES, align, license_scan

    mit = TEMPLATES["mit"]
    changed = mit.replace("without restriction", "with no restriction").replace("publish, ", "")
    rows = [(1, prose(20) + " " + changed + " " + prose(20)), (2, "All rights reserved."), (3, prose(50)), (4, None), (5, ""), (6, "all RIGHTS reserved\n" * 400), (7, mit[:60])]
    got = {r.doc_id: r.matches for r in license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [m.license for m in got[1]] == ["mit"] and 0.9 < got[1][0].coverage < 1 and got[1][0].start_word == 20
    assert [(m.license, m.coverage, m.start_byte, m.end_byte) for m in got[2]] == [("all-rights-reserved", 1.0, 0, 19)]
    assert len(got[6]) == 400 and not got[3] and not got[4] and not got[5] and not got[7]
    assert align(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 7, 4]), np.arange(4) + 1, np.full(4, 2)) == (3, 1, 5)
    full = " ".join([TEMPLATES["bsd-3-clause"], "x"])
    two = {r.doc_id: [m.license for m in r.matches] for r in license_scan(spark.createDataFrame([(1, full), (2, TEMPLATES["bsd-2-clause"]), (3, TEMPLATES["mit-permission"]), (1, full), (4, TEMPLATES["isc"] + prose(3) + " " + TEMPLATES["isc"])], "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("matches", F.lit(2))).collect()}
    assert two == {1: ["bsd-3-clause"], 2: ["bsd-2-clause"], 3: ["mit-permission"], 4: ["isc", "isc"]}


def test_licenses_equal_whole_alignments(spark):
    """Edited templates among words that no template has: the banded alignment finds what a full one does."""
    from weft.llm.licenses import license_scan

    words = [f"w{k}" for k in range(300)]
    templates = {f"t{n}": " ".join(RNG.choice(words, n)) for n in (12, 40, 160)}
    rows, want = [], {}
    for k in range(45):
        name = list(templates)[k % 3]
        t = templates[name].split()
        edited = []
        for w in t:
            roll = RNG.random()
            edited += [] if roll < 0.04 else [w, prose(1)] if roll < 0.08 else [prose(1)] if roll < 0.1 else [w]
        if k % 5 == 0:
            edited[len(edited) // 2 : len(edited) // 2] = prose(len(t) // 5).split()
        text = prose(30).split() + edited + prose(400 if k == 7 else 20).split()
        score = np.zeros((len(t) + 1, len(text) + 1), int)
        for i, w in enumerate(t):
            for j, x in enumerate(text):
                score[i + 1, j + 1] = score[i, j] + 1 if w == x else max(score[i, j + 1], score[i + 1, j])
        rows.append((k, " ".join(text)))
        want[k] = (name, int(score[-1, -1]) / len(t))
    got = {r.doc_id: [(m.license, m.coverage) for m in r.matches] for r in license_scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates, least=0.5).collect()}
    assert sum(got[k] == [want[k]] for k in want) >= 43 and all(len(m) <= 1 and (not m or m[0][1] <= want[k][1]) for k, m in got.items())


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_empty_tables(spark, tmp_path, name):
    from weft.llm import queries

    for table, schema in {"documents": DOCS, "benchmark": "item_id bigint, text string", "labels": "doc_id bigint, quality int, toxic int", "embeddings": "vec_id bigint, embedding array<float>, label int"}.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    query = next(q for k, q in queries.queries().items() if k.startswith(name + "_"))
    assert query(spark, str(tmp_path)).collect() == []


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, label string, node int, row int, key string, own string, `a.b` int"


def odd_docs(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "s", "l", 1, 2, "k", "o", 3) for r in rows], ODD)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_inputs(spark, k):
    """Nulls in any column, empty, long and repeated texts, no rows, clashing names."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = [r for r in ROWS if r[0] is not None] + [(None, prose(40), None, None, None), (500, None, "aa", "s", 0), (500, None, "aa", "s", 0), (501, prose(60_000), None, None, None)]
    docs = odd_docs(spark, rows)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, sf).collect()
    none = stage(spark, docs.limit(0), sf)
    assert none.count() == 0
    if k < 4:
        assert none.columns == docs.columns and all(r["a.b"] == 3 and r.row == 2 and r.own == "o" for r in out)
    texts = Counter(r.text for r in out) if k < 4 else None
    if name == "quality classifier":
        assert 0 < len(out) <= len(rows)
    elif name == "simhash near dedup":
        assert texts[None] == 3 and texts[""] == 1 and texts[ROWS[8][1]] == 1 and max(n for t, n in texts.items() if t and t.split()) == 1
    elif name in ("suffix array dedup", "benchmark decontamination"):
        assert len(out) == len(rows) and texts[None] == 3 and all(r.n_chars == len(r.text) for r in out if r.text is not None)
    else:
        assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(r[0] for r in rows)


def test_near_copies_equal_brute_force_on_test_data(spark):
    """Recall of near copies on the given tables: every group of chains of similarity 0.8 keeps one."""
    from weft.llm.near_copies import without_copies

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s or ():
            where[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for x in s or () for j in where[x] if j < i)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted(i for i in sets if sets[i] is None or find(i) == i)
    assert sorted(r.doc_id for r in without_copies(docs).select("doc_id").collect()) == want


def test_held_out_accuracy(spark):
    """What is learned from the other rows holds for those left out."""
    from weft.llm import queries

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lang = queries.op3_language_id(spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    assert lang.where("lang = lang_pred").count() >= 0.97 * lang.count() > 100
    quality = queries.op5_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id")
    assert quality.where("predicted = quality").count() >= 0.9 * quality.count() > 50


def test_language_on_odd_inputs(spark):
    """Many languages are all learned; copies teach once; rows repeat; names clash; long texts; ties go by name."""
    from weft.llm.language import fit, languages

    words = {f"l{k:03}": ["".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for k in range(230)}
    rows = [(n, " ".join(RNG.choice(w, 40))) for n, w in words.items() for _ in range(3)] + [("l000", " ".join(words["l000"]))] * 500
    train = spark.createDataFrame(rows, "lang string, text string")
    learned = fit(train, rows=2)
    assert learned[0] == sorted(words)
    test = [(k, " ".join(RNG.choice(words[n], 30)), n) for k, n in enumerate(sorted(words)[::11])]
    test += [test[0], (900, " ".join(RNG.choice(words["l003"], 20_000)), "l003")]
    got = languages(spark.createDataFrame(test, "doc_id bigint, text string, lang string").withColumn("key", F.lit(1)).withColumn("shares", F.lit(1)), learned).collect()
    want = {k: n for k, _, n in test}
    assert len(got) == len(test) and sum(r.lang_pred == want[r.doc_id] for r in got) >= 0.95 * len(got)
    both = fit(spark.createDataFrame([("b", "one two"), ("a", "one two")], "lang string, text string"))
    assert languages(spark.createDataFrame([(1, "one")], "doc_id bigint, text string"), both).first().lang_pred == "a"


def test_quality_on_odd_inputs(spark):
    """Repeated and disputed keys, long texts, a score column that is there already, ties of scores."""
    from weft.llm.quality import fit, score

    rows = [(k, (prose(60) if k % 2 else "spam " * 40)) for k in range(40)]
    docs = spark.createDataFrame([*rows, *rows[:5] * 30, (77, prose(30_000)), (78, None)], "doc_id bigint, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 0), (77, 1), (78, 1), (5, 1), (6, 9)], "doc_id bigint, quality int")
    learned = fit(docs, labels)
    assert learned[2] == 40  # 3 is disputed, 78 has no text, of 6 one label counts
    out = score(docs, learned)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == docs.count()
    by = {r.doc_id: r.score for r in out.collect()}
    assert all((by[k] >= 0.5) == bool(k % 2) for k in range(7, 40)) and by[0] == by[2]


def test_repeated_vectors(spark):
    from weft.llm.embeddings import near_vectors

    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (None, [0.0, 1.0], 0)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert bag((r.vec_id, r.n_links, r.component_id) for r in got) == bag([(1, 1, 1), (1, 1, 1), (2, 1, 2), (None, 1, 2)])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
            docs.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0


def test_folded_features_unfold_to_the_same_ids_and_shares():
    from weft.llm import quality

    for counts in ([1, 2, 300, 70_000], [1, 1, 3, 2], []):
        ids, c = np.array([3, 65_536, 131_071, 262_143][: len(counts)], np.int32), np.array(counts, np.int64)
        low, n, parts = quality._folded(ids, c, 18)
        assert len(low) == 2 * len(ids) and len(parts) == 4
        got = quality._unfolded(memoryview(low), memoryview(n), np.array(parts), 80_000)
        assert got[0].tolist() == ids.tolist() and got[1].tolist() == (c / 80_000).astype(np.float32).tolist()


def test_quality_features_stay_off_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from weft.llm import quality

    def refuse(self):
        raise AssertionError("features reach the driver")

    monkeypatch.setattr(Classic, "toArrow", refuse)
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "bad junk there") for k in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    learned = quality.fit(docs, labels)
    assert learned[2] == 40
    scores = {r.doc_id: r.score for r in quality.score(docs, learned).collect()}
    assert all((scores[k] > 0.5) == bool(k % 2) for k in range(40))
    weights, constant, n = quality.fit(docs, labels.where("quality > 1"))
    assert not weights.any() and (constant, n) == (0.0, 0)


def test_all_labelled_rows_and_features_teach(spark):
    """Whichever row's text changes, what is learned does; a slice holds few rows."""
    from weft.llm import quality

    docs = spark.createDataFrame([(k, prose(20)) for k in range(80)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k // 2 % 2) for k in range(80)], "doc_id bigint, quality int")
    learned = quality.fit(docs, labels, rows=8)
    assert learned[2] == 80
    for k in (0, 33, 79):
        other = docs.withColumn("text", F.when(F.col("doc_id") == k, "other words").otherwise(F.col("text")))
        assert (quality.fit(other, labels, rows=8)[0] != learned[0]).any()
    sizes = quality._taught(docs.join(labels, "doc_id").selectExpr("cast(doc_id % 10 as int) as slice", "quality as label", "text").repartition(3, "slice").sortWithinPartitions("slice"), 18, 8).groupBy("slice").agg(F.max("n").alias("n"), F.count("*").alias("c")).collect()
    assert [(r.n, r.c) for r in sizes] == [(8, quality.CHUNKS)] * 10
    long = " ".join(f"w{k}" for k in range(40_000)).encode()
    bags = quality._Folded()
    bags.add(pa.array([long.decode(), ""]), pa.array([1, 0]), 18)
    every, first = quality.features(np.frombuffer(long, np.uint8), np.array([0, len(long)]), 18)
    assert bags[0][0].tolist() == np.unique(every).tolist() and len(bags[0][0]) > 20_000 and len(bags[1][0]) == 0 and abs(bags[0][1].sum() - 1) < 1e-3


def test_rare_class_teaches_many_slices(spark):
    from weft.llm import quality

    docs = spark.createDataFrame([(k, prose(30) if k > 1 else "spam $$$ " * 20) for k in range(102)] + [(200, "spam $$$ " * 9)], "doc_id bigint, text string")
    learned = quality.fit(docs, spark.createDataFrame([(k, int(k > 1)) for k in range(102)], "doc_id bigint, quality int"), rows=10)
    assert learned[2] == 102 and quality.score(docs.where("doc_id = 200"), learned).first().score < 0.5
