"""Operators of the llm subpackage against brute force, round trips and odd inputs."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from postmill.llm import bpe, chat, fingerprint, huffman, neardup, packing, substring, topk, toxicity, warc
from postmill.llm.shared import shared_path

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, band int, part string, c1 int"


def documents(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names clash with inner ones."""
    full = [(i, t, None, "s", None if t is None else len(t), "k", 1, "p", None) for i, t in rows]
    return spark.createDataFrame(full, DOC).repartition(3)


def prose(seed, n, words=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Odd texts, copies, near copies, shared passages, repeated rows, a null id."""
    passage = prose(99, 30, 500)
    base = prose(1, 200, 400)
    near = base.replace(base.split()[100], "changed", 1)
    rows = [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One"), (5, "one two"), (6, base), (7, base.upper()), (8, near),
        (9, prose(2, 40, 300) + " " + passage), (10, passage + " " + prose(3, 40, 300)), (11, "same " * 70), (12, "same " * 50 + "end"),
        (13, prose(4, 6000, 4000)), (14, "Straße’s ΑΣ <|endoftext|> don't ½ 日本語😀"), (15, passage), (15, passage), (-3, prose(5, 25, 9)),
        (None, passage + " tail"), (None, None), (16, "x" * 3000),
    ]
    return rows + [(100 + k, " ".join("z" if i % 23 == k else w for i, w in enumerate(base.split()))) for k in range(12)]


def kept_words(rows, window=20):
    """Words that no earlier equal window covers; rows of one id and text count once."""
    seen = {}
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    for known, number, text in order:
        own = text.encode().split()
        for p in range(len(own) - window + 1):
            place, gram = (known, number, p), tuple(own[p : p + window])
            seen[gram] = min(seen.get(gram, place), place)
    out = []
    for i, t in rows:
        own = (t or "").encode().split()
        gone = set()
        for p in range(len(own) - window + 1):
            if seen[tuple(own[p : p + window])] != (i is not None, i or 0, p):
                gone.update(range(p, p + window))
        out.append((i, t, len(own), len(gone), b" ".join(w for j, w in enumerate(own) if j not in gone).decode()))
    return sorted(out, key=str)


def test_substring(spark, corpus):
    got = substring.cut_repeats(documents(spark, corpus)).select("doc_id", "text", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == kept_words(corpus)


def test_substring_stage_keeps_columns(spark, corpus):
    docs = documents(spark, corpus)
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert rows[(2, " \t\n ")].key == "k" and all(r.n_chars == len(r.text) for r in rows.values() if r.text is not None)


def shingles(text, width):
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + width]) for i in range(len(own) - width + 1)} or ({tuple(own)} if own else set())


def expected_components(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    above = {i: i for i, _ in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                above[max(x, y)] = min(x, y)
    return {i: top(i) for i in above}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, width, percent):
    expected = expected_components(corpus, width, percent)
    got = neardup.near_duplicates(documents(spark, corpus), width, percent).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    sizes = {(i, len(shingles(t, width))) for i, t in corpus}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes


def test_near_duplicates_chain_and_tiles(spark, monkeypatch):
    """A chain of edits is one component though its ends differ, with tiles of two members too."""
    monkeypatch.setattr(neardup, "TILE", 4)
    own, rows = prose(7, 120, 5000).split(), []
    for k in range(24):
        own = [*own]
        own[(k * 5) % 120] = f"edit{k}"
        rows.append((k, " ".join(own)))
    got = neardup.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == expected_components(rows, 3, 85)


def test_near_duplicate_tiles(spark, monkeypatch):
    """Members of different components meet in one tile; copies of one component are not multiplied by their number."""
    monkeypatch.setattr(neardup, "TILE", 4)
    members = [(1, i, 0) for i in range(200)] + [(1, 999, 999)] + [(2, i, 0) for i in range(50)]
    members += [(3, i, i // 30 if i < 60 else i // 2) for i in range(75)] + [(4, i, i) for i in range(11)]
    frame = spark.createDataFrame([(k, 1, i, p) for k, i, p in members], "key bigint, band tinyint, id bigint, part bigint")
    rows, tiles = defaultdict(int), defaultdict(list)
    for r in neardup._dealt(frame).collect():
        rows[r.key] += 1
        tiles[r.key, r.i, r.j].append(r)
    assert rows[1] == 200 + 50 + 1 and 2 not in rows
    met = defaultdict(int)
    for (key, i, j), own in tiles.items():
        for a in own:
            for b in own:
                if a.id < b.id and a.part != b.part and (i == j or a.chunk != b.chunk):
                    met[key, a.id, b.id] += 1
    wanted = {(k, i, j) for k, i, p in members for m, j, q in members if k == m and i < j and p != q}
    assert set(met) == wanted and set(met.values()) == {1}


@pytest.mark.parametrize("s", [0.8, 0.85])
def test_near_duplicate_slack(s):
    """A pair at the threshold is lost by its estimate with a probability below 1e-7 (exact binomial tail)."""
    n = neardup.REGISTERS
    lost = sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(n + 1) if k / n < s - neardup.SLACK)
    assert lost < 1e-7


def test_near_duplicate_stage(spark, corpus):
    docs = documents(spark, corpus)
    out = neardup.drop_near_duplicates(docs)
    expected = expected_components(corpus, 5, 80)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == sorted(i for i in expected if expected[i] == i)
    assert ids.count(None) == 2


def test_near_duplicate_stage_judges_rows(spark):
    """Different texts of one id stay, unless their own text is a near copy; a null text displaces nothing."""
    a, b, c, d = (prose(50 + k, 120, 3000) for k in range(4))
    near = lambda text: text.replace(text.split()[60], "changed", 1)
    rows = [(1, a), (5, near(a)), (5, b), (6, None), (6, c), (6, None), (7, d), (7, near(d)), (7, d.upper()), (8, near(b)), (9, ""), (9, " ")]
    got = neardup.drop_near_duplicates(documents(spark, rows)).collect()
    # 5's first text is a copy of 1's, 8's of 5's second; 7's three texts are one group.
    texts = sorted([(r.doc_id, r.text) for r in got if r.doc_id != 7], key=str)
    assert texts == sorted([(1, a), (5, b), (6, None), (6, c), (9, ""), (9, " ")], key=str)
    assert [r.doc_id for r in got].count(7) == 1


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        own = [f"w{rng.randrange(300)}" for _ in range(40)]
        if i % 4 == 0:
            own[rng.randrange(40)] = rng.choice(["Idiot,", "scum.", "moron"])
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None), (1001, ""), (None, "scum"), (5, rows[5][1])]
    table = spark.createDataFrame([*labels, (7, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_documents(documents(spark, rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    kept = toxicity.drop_toxic(documents(spark, rows), table)
    assert kept.columns == documents(spark, rows).columns and 1000 in {r.doc_id for r in kept.collect()}


def test_toxicity_sample_is_bounded(spark):
    """A labelled id that most rows repeat brings one row for each of its texts, within the bounds in rows and bins."""
    rows = [(1, f"same text {k % 3}") for k in range(300)] + [(2, "other words here")] * 20 + [(k, f"word{k} fine") for k in range(3, 40)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id bigint, quality int, toxic int")
    take = lambda rows_, bins: toxicity.sample_of(documents(spark, rows), labels, None, rows_, bins, "doc_id", "text", "toxic")
    full = take(1000, 10**6)
    assert len(full) == 3 + 1 + 37 and {y for y, _ in full} == {0, 1}
    assert all(sum(y == c for y, _ in take(5, 10**6)) == 5 for c in (0, 1))
    few = take(1000, 100)
    assert sum(len(b) for _, b in few) <= 100 and {y for y, _ in few} == {0, 1}


def test_toxicity_pairs():
    """A pair of terms that alone say nothing is learned by the factors."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append((int(a and b), np.array([x for x, on in ((1, a), (2, b), (3 + rng.integers(0, 5), 1)) if on])))
    model = toxicity.fit(rows)
    offsets = np.array([0, 1, 2, 4])
    alone_a, alone_b, both = model.scores(np.array([1, 2, 1, 2]), offsets)
    assert both > 0.5 > max(alone_a, alone_b)


def test_toxicity_pairs_through_train(spark):
    """Toxic by a pair whose two terms are each as frequent in clean rows as in toxic ones."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        own = [f"w{rng.randrange(300)}" for _ in range(30)]
        own[:2] = [("gruppe", "hasswort"), ("idiot", own[1]), ("gruppe", own[1]), (own[0], "hasswort")][i % 4]
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(i % 4 < 2)))
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    held = [r for r in toxicity.score_documents(documents(spark, rows), table).collect() if r.held_out]
    for kind in range(4):
        own = [r.predicted == int(kind < 2) for r in held if r.doc_id % 4 == kind]
        assert sum(own) >= 0.9 * len(own)


def test_toxicity_unknown_terms():
    """A clean text of 20,000 distinct words that no training row held scores as one without words."""
    rng = np.random.default_rng(2)
    rows = [(i % 2, np.unique(np.append(rng.integers(0, 200, 20), 500 + i % 2))) for i in range(400)]
    model = toxicity.fit(rows)
    bins, offsets = toxicity.term_bins(pa.array(["".join(f" {k}word" for k in range(20_000)), ""]))
    fresh = bins[(bins >= 200) & (bins != 500) & (bins != 501)]
    assert len(fresh) > 19_000
    long, empty = model.raw(fresh, np.array([0, len(fresh), len(fresh)]))
    assert abs(long - empty) < 1e-9


def test_packing(spark, corpus):
    tokenizer = Tokenizer.from_file(WORD_FILE)
    rows = [(i, t) for i, t in dict(corpus).items() if i is not None]
    got = packing.pack(documents(spark, rows), WORD_FILE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in rows:
        ids = np.array([*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == ids.tobytes()
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
        total = pieces[-1].offset + pieces[-1].length
        assert total <= 4096 and total & (total - 1) == 0


def test_special_tokens_in_texts():
    """Ids are those of the unmodified library, also where a text holds the strings of special tokens."""
    from postmill.llm.wordids import WordIds

    tokenizer = Tokenizer.from_file(WORD_FILE)
    texts = ["hello <|endoftext|> x<|startoftext|>y", "<|endoftext|>", "a<|endoftext|>, b.<|startoftext|><|endoftext|>.", "Ä<|ENDOFTEXT|> <|endoftext |>"]
    ids, offsets = WordIds(WORD_FILE).batch(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_sum_of_squares_choice():
    """The level taken is one with the smallest sum of squares, by trying all."""
    rng = random.Random(5)
    packer = packing.Packer(32, 1000)
    for k in range(400):
        size = rng.randrange(1, 32)
        n = packer.levels.copy()

        def squares(level, size=size, n=n):
            after = n.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            return int((after**2).sum())

        fits = [0, *[h for h in range(1, 33 - size) if n[h]]]
        assert squares(packer.level_for(size)) == min(map(squares, fits))
        list(packer.add(k, np.zeros(size, np.uint32)))


def test_bpe(spark, corpus):
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.digests(bpe.encode(documents(spark, corpus), RANKS, public_tokenizers.PATTERN)).collect()
    expected = []
    for i, t in corpus:
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4")
        expected.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_bpe_newer_letters(spark):
    """Letters and numbers of Unicode 14 to 16, which the JVM doesn't know, alone and among others."""
    newer = ["\u0870", "\u0cdd", "\u1711\u171f", "\U00012f90", "\U00011f04", "\U00031350", "\U0001e4d0", "\U00011f50", "\U0002ebf0", "\u1c89", "\U00010d40", "\U0001ccf0"]
    others = ["'s", " ", "  ", "\n", "\t", "a", "Ä", "1", "½", ".", "'ll", "\u00a0", "\u3000", "don't", "\U0001fae0", "\uffff", "😀"]
    rng = random.Random(6)
    texts = [f"{c}'s a" for c in newer] + [f"x {c}'ll b" for c in newer] + ["y" * 20_000 + newer[0] + ",z" * 20_000]
    texts += ["".join(rng.choice([*newer, *others]) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.encode(documents(spark, list(enumerate(texts))), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(texts[r.doc_id]), texts[r.doc_id][:80]
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_huffman(spark, corpus):
    tokenizer = Tokenizer.from_file(WORD_FILE)
    path = shared_path(spark, "test-ids")
    huffman.write_ids(documents(spark, corpus), WORD_FILE, path, shared_path(spark, "test-tokens"))
    got = huffman.read_ids(spark, path).collect()
    starts = 0
    texts = defaultdict(list)
    for i, t in corpus:
        texts[i].append(np.array([*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 1], "<u4").tobytes())
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == starts and bytes(r.ids) in texts[r.doc_id] and r.n_tokens == len(r.ids) // 4
        starts += r.n_tokens
    assert len(got) == len(corpus)


@pytest.mark.parametrize("longest", [4, 6, 16])
def test_code_lengths(longest):
    rng = random.Random(longest)
    counts = {i: rng.randrange(1, 10) ** 6 for i in range(13)}
    bits = huffman.code_lengths(counts, longest)
    assert max(bits.values()) <= longest and sum(2.0**-b for b in bits.values()) <= 1
    code = huffman.Code(bits)
    ids = np.array(rng.choices(list(counts), k=3000))
    stream, checkpoints = code.encode(ids)
    assert (code.decode(stream, checkpoints, len(ids)) == ids).all()
    assert huffman.code_lengths({7: 3}) == {7: 1} and huffman.code_lengths({}) == {}


def test_warc(spark):
    big = "ä" * 700_000
    rows = [
        (3, "http://a/\r\nx", big), (1, None, big), (2, "u", "y" * 99), (4, "u", "y" * 99), (5, "u", None), (6, "ü", ""),
        (7, "u", "z" * 100), (7, "u", "z" * 100), (8, "u", "z" * 100), (None, "u", "z" * 100), (None, "u", "q" * 300),
    ]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id bigint, url string, html string, digest string")
    path = shared_path(spark, "test-warc")
    warc.write_archive(pages, path, chunk_bytes=100_000)
    got = sorted((tuple(r) for r in warc.read_archive(spark, path).drop("url").collect()), key=str)
    expected = []
    for page, _, html in rows:
        payload = (html or "").encode()
        equal = [p for p, _, h in rows if h == html and p is not None]
        first = min(equal) if len(payload) >= 100 and equal else page
        kind = "response" if page == first else "revisit"
        expected.append((page, len(payload), hashlib.sha256(payload).hexdigest(), kind, None if page == first else first))
    assert got == sorted(expected, key=str)
    assert spark.read.parquet(path).where("chunk_no > 10").count() > 0


def test_topk(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.5]) for _ in range(20 + i % 3)]) for i in range(250)]
    rows += [(300, None), (400, [1.0, None]), (500, [float("nan")] * 3), (600, [float("inf")]), (700, []), (None, [1.0]), (100, rows[100][1]), (5, [1e30])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, part int, score int")
    got = defaultdict(list)
    for r in topk.top_k(frame, frame["vec_id"] % 100 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {i: v for i, v in usable if i % 100 == 0}
    top = 2**63 - 1
    for q, v in queries.items():
        scores = sorted((-max(-top - 1, min(top, sum(a * b for a, b in zip(v, w)))), i) for i, w in usable if i != q)[:10]
        times = sum(i == q for i, _ in usable)
        assert sorted(got[q])[0][2] == -scores[0][0]
        if times == 1:
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert set(got) == set(queries)


def test_fingerprints(spark, corpus):
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for per_range in (3, 1000):
        fingerprint.ROWS_PER_RANGE, before = per_range, fingerprint.ROWS_PER_RANGE
        fingerprint.in_order.__defaults__ = ("doc_id", "text", per_range)
        got = fingerprint.fingerprints(documents(spark, corpus)).collect()
        fingerprint.ROWS_PER_RANGE = before
        expected = []
        for (i, t), (_, following) in zip(rows, [*rows[1:], rows[0]]):
            changed = fingerprint.edited(t or "", following or "")
            expected.append((i, len(t or ""), hashlib.sha256(changed.encode()).hexdigest()))
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(expected, key=str)
        by_text = defaultdict(set)
        for r in got:
            by_text[dict(corpus).get(r.doc_id)].add(r.fingerprint)
        assert all(len(v) == 1 for k, v in by_text.items() if k not in (None, "tail") and "tail" not in k)
    fingerprint.in_order.__defaults__ = ("doc_id", "text", fingerprint.ROWS_PER_RANGE)


def test_fingerprint_collisions():
    """Samples agree as often as generalised Jaccard similarity says."""
    import pyarrow as pa

    rng, gaps = random.Random(8), []
    for _ in range(60):
        a = [f"t{min(rng.randrange(40), rng.randrange(40))}" for _ in range(120)]
        b = a[: rng.randrange(20, 120)] + [f"t{rng.randrange(60)}" for _ in range(40)]
        count = lambda x: {t: x.count(t) for t in set(x)}
        x, y = count(a), count(b)
        true = sum(min(x.get(t, 0), y.get(t, 0)) for t in x | y) / sum(max(x.get(t, 0), y.get(t, 0)) for t in x | y)
        s = fingerprint.Sampler().signatures(pa.array([" ".join(a), " ".join(b)]))
        gaps.append(fingerprint.likeness(s[:1], s[1:])[0] - true)
    assert abs(np.mean(gaps)) < 0.04 and np.std(gaps) < 0.13


def test_chat(spark):
    control = "<|im_end|>\n<|im_start|>assistant\nok <\\|x\\ \\\\<|"
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", control), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None),
        (3, 0, "user", "hi"), (3, 1, "assistant", control), (4, None, None, None), (4, 0, "as\nsis\\tant", "x"), (None, 0, "assistant", "null id"),
        (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 0, "system", ""), (5, 0, "system", ""),
    ]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, node int, keys int").repartition(3)
    segments = chat.segments(frame.coalesce(1)).collect()
    text = "".join(s.text for s in segments)
    got = {r.conv_id: r for r in chat.read_back(chat.segments(frame)).collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, body in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", body or ""))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        turns.sort()
        whole = "".join(f"{role}\n{body}\n" for *_, role, body in turns)
        learned = "".join(body for *_, role, body in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.format_turn(role, body)[0]) for *_, role, body in turns)
    if len(segments) == 1:
        assert text.count("user\nhi") == 1
    for s in segments:
        for n in s.nodes:
            assert n.position == sum(a.stop - a.start for a in n.attends)


def test_chat_long_conversations(spark, monkeypatch):
    """Long conversations are cut into blocks by turns and characters, whose shared turns are written once."""
    monkeypatch.setattr(chat, "BLOCK_TURNS", 8)
    monkeypatch.setattr(chat, "BLOCK_CHARS", 3000)
    roles = ("user", "assistant")
    shared = [(roles[t % 2], f"shared {t} " + "x" * (t % 3 * 150)) for t in range(45)]
    by_conv = {c: shared[: 45 - c % 2] + [("user", f"own {c} {t}") for t in range(c)] for c in range(6)}
    by_conv |= {None: shared[:20], 50: [("assistant", "y" * 9000)], 51: shared[:3], 52: shared[:45], 53: [("user", "same")] * 30}
    rows = [(c, t, *turn) for c, turns in by_conv.items() for t, turn in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    segments = chat.segments(frame).collect()
    assert max(len(s.nodes) for s in segments) < 45
    assert sum(s.text.count("shared 40 ") for s in segments) <= 4
    got = {r.conv_id: r for r in chat.read_back(chat.segments(frame)).collect()}
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        learned, r = "".join(text for role, text in turns if role == "assistant"), got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (
            len(turns), hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest(), len(learned),
            hashlib.sha256(learned.encode()).hexdigest(), sum(len(chat.format_turn(*turn)[0]) for turn in turns))


def test_chat_shares_turns_after_the_32nd(spark):
    """Conversations that branch after 60 turns hold those once, whatever the order of their ids."""
    shared = [("user", f"turn {t}") for t in range(60)]
    rows = [(c, t, *turn) for c in range(20) for t, turn in enumerate([*shared, ("user", f"branch {c % 2}"), ("user", f"end {c}")])]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        text = "".join(s.text for s in chat.segments(frame).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert text.count("branch 0") == text.count("branch 1") == 1


def test_empty_tables(spark):
    docs = documents(spark, []) if False else spark.createDataFrame([], DOC)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    path = shared_path(spark, "empty")
    huffman.write_ids(docs, WORD_FILE, path, shared_path(spark, "empty-tokens"))
    warc.write_archive(pages, f"{path}-warc")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    for frame in (
        toxicity.score_documents(docs, labels), toxicity.drop_toxic(docs, labels), packing.pack(docs, WORD_FILE),
        bpe.digests(bpe.encode(docs, RANKS, public_tokenizers.PATTERN)), neardup.near_duplicates(docs), neardup.drop_near_duplicates(docs),
        substring.cut_repeats(docs), substring.remove_repeats(docs), topk.top_k(vectors, vectors["vec_id"] % 100 == 0),
        huffman.read_ids(spark, path), warc.read_archive(spark, f"{path}-warc"), fingerprint.fingerprints(docs), chat.read_back(chat.segments(turns)),
    ):
        assert frame.count() == 0


def test_pipeline(spark, sf):
    """Every document of the input is packed unless a stage had reason to drop it, and stages keep the columns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = shared_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    packed = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    assert packed == {r.doc_id for r in docs.select("doc_id").collect()}
