"""Each operator against plain Python, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import embedding, html_text, language, media, packing, pieces, simhash, token_shards, toxicity, url_filter

TEXTS = [None, "", " ", "one", "a b c d e f", "A b C d e f", "x" * 300_000, "word " * 40_000, "\n\n", "né à ß 日本", "a b c d e f", "one<|endoftext|> two"]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward texts beside columns named like results."""
    return spark.createDataFrame([(i, t, "q", i) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "q", 4), (None, "null key", None, None)], "doc_id long, text string, fp string, score int").repartition(3)


def tokenizer(name):
    return pytest.importorskip("public_tokenizers").path(name)


# --- 1

def brute_fingerprint(text, k=3):
    import xxhash

    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = [x for x in w.translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if x]
    if not w:
        return 0
    sh = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, keys, bits=3):
    up = list(range(len(codes)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(keys):
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] for i in range(len(codes))]


def test_simhash_of_awkward_texts(docs):
    rows = simhash.near_duplicates(docs.where("doc_id is not null")).collect()
    assert len(rows) == len(TEXTS) + 1
    codes = {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}
    assert all(int(r.fingerprint, 16) == codes[r.doc_id] and len(r.fingerprint) == 16 for r in rows)
    want = dict(zip(codes, brute_components(list(codes.values()), list(codes))))
    assert {r.doc_id: r.component_id for r in rows} == want


def test_simhash_null_key_and_empty_table(spark, docs):
    assert simhash.near_duplicates(docs.where("doc_id is null")).first().component_id is None
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs.withColumnRenamed("doc_id", "component_id"), key="component_id")


@pytest.mark.parametrize("group", [1 << 16, 6])
def test_links_find_every_component(spark, group):
    r = random.Random(7)
    codes = set()
    for _ in range(4):
        base = r.getrandbits(64)
        for _ in range(10):
            c = base
            for _ in range(r.randrange(5)):
                c ^= 1 << r.randrange(64)
            codes.add(c)
    codes = sorted(codes)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    up = {c: c for c in codes}

    def find(c):
        while up[c] != c:
            c = up[c]
        return c

    for x in simhash.links(df, group=group).collect():
        a, b = x.src % (1 << 64), x.dst % (1 << 64)
        up[find(a)] = find(b)
    want = brute_components(codes, codes)
    got = {}
    for c in codes:
        got.setdefault(find(c), set()).add(c)
    assert {min(g): g for g in got.values()} == {k: {c for c, w in zip(codes, want) if w == k} for k in set(want)}


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 4, 6, 7, 9, 11] and ids.count(None) == 1


@pytest.mark.parametrize("group", [1 << 16, 4])
def test_similar_documents(spark, group):
    r = random.Random(4)
    texts, family = [], []
    for f in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(300)]
        for c in range(6):
            own = list(base)
            for _ in range(c):
                own[r.randrange(300)] = f"x{r.randrange(5000)}"
            texts.append(" ".join(own))
            family.append(f)
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), group=group).collect()}
    first = {f: family.index(f) for f in family}
    assert all(first[family[c]] == first[family[i]] for i, c in got.items())
    assert np.mean([got[i] == first[f] for i, f in enumerate(family)]) > 0.97


# --- 2

def test_token_shards_round_trip(spark, docs):
    from tokenizers import Tokenizer

    file = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(file)
    got = token_shards.token_shards(docs, file).orderBy("start").collect()
    want = sorted([(-1, "null key")] + [(i, x or "") for i, x in enumerate(TEXTS)] + [(4, TEXTS[4])])
    start = 0
    for r, (k, x) in zip(got, want, strict=True):
        ids = t.encode(x, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (None if k < 0 else k, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    assert token_shards.token_shards(docs.limit(0), file).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    file = tokenizer("byte_bpe_50k.json")
    plain = Tokenizer.from_file(file)
    with open(file, encoding="utf-8") as f:
        e = token_shards.Encoder(f.read(), 2)
    r = random.Random(2)
    parts = ["a", "né", "x1", "'s", " ", "  ", "\n", "\n\n", " \n", "\t", ".", ",", "!?", "\xa0", "\u3000", "中文", "🙂", "<|endoftext|>", "-", "%%%"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(5000)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in e(texts)] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 9), (700, 3), (700, 10**6), (700, 10**13)])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top, n)).astype(np.uint64)
    f = token_shards.EliasFano.load(token_shards.EliasFano.of(v).dump())
    assert (f.slice(0, n) == v).all() and all(f.select(i) == v[i] for i in range(0, n, 37))
    assert n < 700 or (f.slice(255, 513) == v[255:513]).all()


# --- 3

LANGS = {"en": "the cat and the dog went over there with this thing ", "de": "der hund und die katze sind nicht auf dem baum gewesen ", "fr": "le chien et les oiseaux sont dans une maison avec nous "}


def sentence(r, lang, n=25):
    w = LANGS[lang].split()
    return " ".join(r.choice(w) + r.choice(w)[:2] for _ in range(n))


def test_language(spark):
    r = random.Random(0)
    rows = [(i, sentence(r, lang := r.choice(list(LANGS))), lang) for i in range(300)] + [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (None, "the cat", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.language_id(df).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002)) and not by[None].held_out
    held = [x for x in got if x.held_out and x.doc_id < 300]
    assert np.mean([x.lang_pred == rows[x.doc_id][2] for x in held]) > 0.95 and all(0 <= x.score <= 1 for x in got)
    assert {x.doc_id for x in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    nothing = language.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {x.lang_pred for x in nothing} == {"und"} and language.language_id(df.limit(0)).count() == 0


def test_long_texts_are_read_whole(spark):
    r = random.Random(1)
    learned = {k: (" ".join(sentence(r, k) for _ in range(30)).encode(), 1 / 3) for k in LANGS}
    text = sentence(r, "fr", 100) + " " + sentence(r, "de", 5000)
    assert language.Model(learned).predict(text)[0] == "de"


# --- 4

def test_embeddings_against_all_pairs(spark):
    g = np.random.default_rng(5)
    base = g.standard_normal((25, 64))
    v = np.concatenate([base[g.integers(0, 25, 300)] + g.standard_normal((300, 64)) * 0.15, g.standard_normal((100, 64))]).astype(np.float32)
    v = np.concatenate([v, v[:5], v[:1] * 2])
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)]
    odd = [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] + [1.0] * 63), (904, [1.0, 2.0]), (905, []), (906, [float("inf")] * 64), (None, rows[0][1])]
    got = embedding.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("n_links_", F.lit(1))).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.vec_id: r for r in got}
    assert all(by[i].n_links == 0 and by[i].component_id == i for i, _ in odd if i is not None)
    assert (by[None].n_links, by[None].component_id, by[None].kept) == (0, None, False)
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    found = sum(by[i].n_links for i in range(len(v)))
    assert 0.98 * (near.sum() - len(v)) <= found <= near.sum() - len(v)
    assert all(by[i].n_links <= near[i].sum() - 1 for i in range(len(v)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_large_groups_are_cut_into_cells(spark, monkeypatch):
    g = np.random.default_rng(6)
    v = g.standard_normal(64) + g.standard_normal((90, 64)) * 0.02
    monkeypatch.setattr(embedding, "CELL", 20)
    monkeypatch.setattr(embedding, "PART", 8)
    got = embedding.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(89, 0)}


def test_no_vectors(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimate_is_unbiased():
    g = np.random.default_rng(8)
    u = g.standard_normal((4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    code, factor = embedding.encode(u)
    signs = (np.unpackbits(code, axis=1) * 2.0 - 1) / 8 / factor[:, None]
    q = u[0] * 0.6 + g.standard_normal(64) * 0.1
    q /= np.linalg.norm(q)
    error = signs @ (q @ embedding.rotation(64)) - u @ q
    assert abs(error.mean()) < 0.01


# --- 5

def test_media_round_trip(docs):
    import hashlib

    got = media.text_media(docs.where("doc_id is not null")).collect()
    for r in got:
        raw = (TEXTS[r.doc_id] or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.wrap(padded)).hexdigest()
    assert media.text_media(docs.limit(0)).count() == 0


def test_keyframes_point_at_the_payload():
    payload = bytes(range(192)) * 300
    data = media.wrap(payload)
    d = media.describe(data)
    assert (d["codec"], d["samples"], d["duration_s"]) == ("raw ", 300, 12.0)
    for i, (o, n) in enumerate(zip(d["key_offsets"], d["key_sizes"])):
        assert data[o:o + n] == payload[i * 25 * 192:i * 25 * 192 + 192]
    assert media.unwrap(data) == payload


def test_scattered_samples_and_variable_sizes():
    """Two chunks out of order and samples of different sizes, in 64-bit boxes."""
    p = lambda *x: struct.pack(f">{len(x)}I", *x)
    def file(base):
        stbl = media.box(b"stbl", media.STSD, media.full(b"stts", p(1, 3, 10)), media.full(b"stsz", p(0, 3, 2, 3, 4)), media.full(b"stsc", p(2, 1, 2, 1, 2, 1, 1)), media.full(b"co64", p(2), struct.pack(">QQ", base + 4, base)))
        mdia = media.box(b"mdia", media.box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQI", 0, 0, 10, 30, 0)), media.box(b"minf", stbl))
        body = media.FTYP + media.box(b"moov", media.box(b"trak", mdia))
        return body + struct.pack(">I4sQ", 1, b"mdat", 16 + 9) + b"wxyzaabbb", len(body) + 16
    data = file(file(0)[1])[0]
    assert media.unwrap(data) == b"aabbbwxyz" and list(media.describe(data)["key_sizes"]) == [2, 3, 4]


def test_foreign_bytes(spark):
    good = media.wrap(media.pad(b"x"))
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"junk" * 9)), (4, bytearray(good[:200])), (5, bytearray())], "k long, m binary")
    got = {r.k: r for r in media.media_columns(df, "k", "m").collect()}
    assert got[1].codec == "raw " and got[1].keyframes[0]["size"] == 192 and got[1].error is None
    assert all(got[i].codec is None and got[i].error for i in (2, 3, 4, 5))


# --- 6

def one_by_one(lengths, caps, overhead):
    """Best-fit decreasing, a piece at a time, with the same choice of a new bin."""
    left, bins, distinct = Counter(lengths), [], sorted(set(lengths))
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] - b[1] >= n]
        if fit:
            min(fit, key=lambda b: b[0] - b[1])[1] += n
        else:
            def cost(c):
                held = min(left[n], c // n) * n
                held += packing.fill(c - held, distinct, n)
                return (min(x for x in caps if x >= held) + overhead) / held, -c
            bins.append([min((c for c in caps if c >= n), key=cost), n])
        left[n] -= 1
    return sorted((min(c for c in caps if c >= used), used) for _, used in bins)


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_as_tightly_as_one_by_one(seed):
    r = random.Random(seed)
    caps = (16, 32, 64)
    lengths = [min(64, 1 + int(r.expovariate(0.1))) for _ in range(300)]
    plan = packing.solve(Counter(lengths), caps, 2)
    load = Counter()
    for n, rank, many, each, first, at in plan.places.tolist():
        for i in range(many):
            load[first + i // each] += n
    want = one_by_one(lengths, caps, 2)
    assert sum(load.values()) == sum(lengths)
    total = sum(plan.bins[np.searchsorted(plan.bins[:, 0], b, "right") - 1, 1] for b in load)
    assert total <= 1.03 * sum(c for c, _ in want)


def test_pack(spark, docs):
    caps = (512, 1024, 4096)
    got = packing.pack(docs, capacities=caps).collect()
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.n_tokens
    assert tokens[7] == 40_001 and tokens[0] == tokens[1] == tokens[2] == 1 and tokens[4] == 14 and tokens[None] == 3
    spans = {}
    for r in got:
        assert r.capacity in caps and r.offset + r.n_tokens <= r.capacity
        spans.setdefault((r.bin_id, r.capacity), []).append((r.offset, r.offset + r.n_tokens))
    assert len({b for b, _ in spans}) == len(spans)
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert packing.pack(docs.limit(0)).count() == 0


# --- 7

@pytest.mark.parametrize("lost", [False, True])
def test_pieces_equal_the_library(spark, docs, lost, monkeypatch, tmp_path):
    """The very long rows too; and when the second pass finds none of its segments."""
    import sentencepiece

    file = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=file)
    spaces = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["  two  spaces ", " a", "b ", "x\u2581y z", "   ", "a\nb c"])], "doc_id long, text string")
    spaces.union(docs.select("doc_id", "text")).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs")).withColumn("n_tokens_", F.lit(1))
    assert pieces.plain_scan(stored.select("doc_id", "text")) and not pieces.plain_scan(docs)
    got = pieces.encode(docs.select("doc_id", "text") if lost else stored, file)
    if lost:
        monkeypatch.setattr(pieces, "task_segments", lambda path, task, width: iter(()))
        got = pieces.encode(docs, file)
    want = dict(enumerate(TEXTS)) | {r.doc_id: r.text for r in spaces.collect()}
    rows = got.collect()
    assert len(rows) == docs.count() + (0 if lost else spaces.count())
    for r in rows:
        assert list(r.ids) == sp.encode("null key" if r.doc_id is None else want[r.doc_id] or ""), r.doc_id
    back = {r.doc_id: r.text for r in pieces.decode(got, file).collect()}
    assert all(back[i] == (want[i] or "").replace("\u2581", " ") for i in back if i is not None)
    assert pieces.encode(docs.limit(0), file).count() == 0
    trip = {r.doc_id: r for r in pieces.encode(stored, file, digest=True).collect()}
    assert all(r.round_trip for i, r in trip.items()) and trip[0].n_tokens == 0


def test_long_segments_fold_alike():
    file = tokenizer("piece_bpe_32k.model")
    import sentencepiece

    sp, c = sentencepiece.SentencePieceProcessor(model_file=file), pieces.Coder(pieces.Table.read(file))
    for t in ("x" * 3000, "abcdefgh" * 400, "=" * 1001):
        assert [i for w in c.word(c.surface(t)) for s in c.segments(w) for i in c.fold(s)] == sp.encode(t)


@pytest.mark.parametrize("prefix", [True, False])
def test_words_and_segments_are_cut_in_bulk(prefix, monkeypatch):
    """Just as the plain rules cut them, with no call for each word; and wrong ids are seen."""
    import sys
    import pyarrow as pa

    coder = pieces.Coder(pieces.Table.read(tokenizer("piece_bpe_32k.model")))
    coder.table.prefix = prefix
    r = random.Random(5)
    texts = [None, "", " ", "  two  spaces ", " a", "b ", "x\u2581y  z", "\u2581", "a\nb, c.", "\U0001f600 \u4e2d\u6587e\u0301 \x00"] + [
        "".join(r.choice("abcdefe\u00e9\u4e2d ,.\u2581") for _ in range(r.randrange(40))) for _ in range(200)]
    plain = [coder.word(coder.surface(t or "")) for t in texts]
    words, which, at = coder.words(pa.array(texts, pa.string())[0:])
    names = words.to_pylist()
    assert [[names[i] for i in which[a:b]] for a, b in zip(at, at[1:])] == plain and len(set(names)) == len(names)
    number, many, pairs = coder.beside
    for form in (pairs, np.flatnonzero(pairs)):
        coder.__dict__["beside"] = number, many, form
        segs, at = coder.cut(words)
        for w, a, b in zip(names, at, at[1:]):
            ends = [i for i in range(1, len(w)) if w[i - 1:i + 1] not in coder.joined]
            assert segs[a:b].to_pylist() == [w[i:j] for i, j in zip([0, *ends], [*ends, len(w)])]
    own = segs.unique()
    ids = [np.array(coder.fold(x), "<i4").tobytes() for x in own.to_pylist()]
    right = pa.array(ids, pa.large_binary())
    assert not pieces.mistaken(coder, own, right).any()
    odd = pa.array([ids[1], *ids[1:]], pa.large_binary())
    assert pieces.mistaken(coder, own, odd).tolist() == [True] + [False] * (len(own) - 1)
    kept = pieces.Kept(coder, iter([(own[:5], odd[:5])]))
    known, wrong, place = kept.ids(own)
    assert known.take(pa.array(place)).to_pylist() == odd.to_pylist() and wrong[place].tolist() == [True] + [False] * (len(own) - 1)
    assert kept.ids(own[7:9])[2].tolist() == [7, 8]

    calls = [0]
    many = pa.array([" ".join(r.choice(["the", "tree", "ab,", "zq"]) + str(r.randrange(1000)) for _ in range(100)) for _ in range(100)])
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + 1))
    try:
        segs = coder.cut(coder.words(many)[0])[0]
    finally:
        sys.setprofile(None)
    assert len(segs) > 2000 and calls[0] < 1000

    monkeypatch.setattr(pieces, "SLICE", 50)
    rows = [(i, t) for i, t in enumerate([*texts, "long " * 30, None, "x"])]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1] for x in part], pa.string())], ["k", "t"]) for part in (rows[:3], rows[3:100], rows[100:])]
    got = list(pieces.slices(iter(batches)))
    assert [x for b in got for x in zip(*map(pa.Array.to_pylist, b.columns))] == rows and len(got) > 20 and list(pieces.slices(iter([]))) == []


def test_unigram_lattice_takes_the_best_sum(spark):
    table = pieces.Table(["<unk>", "a", "b", "ab", "ba", "aba"], [0, -1.0, -1.5, -1.8, -2.0, -4.0], [2, 1, 1, 1, 1, 1], True, False)
    coder = pieces.Coder(table)
    known = {p: (i, s) for i, (p, s) in enumerate(zip(table.pieces, table.scores)) if i}
    words = ["abab", "aba", "bbaab", "acb"]
    rows = [(w, [(a * 64 + b, *known[w[a:b]]) for a in range(len(w)) for b in range(a + 1, len(w) + 1) if w[a:b] in known]) for w in words]
    df = spark.createDataFrame(rows, "seg string, edges array<struct<span:int,id:int,score:double>>")
    got = {r.seg: r.ids for r in pieces.best_sums(table, df).collect()}
    assert got == {w: coder.fold(w) for w in words} and got["abab"] == [3, 3] and got["aba"] == [3, 1]
    whole = {r.seg: r.ids for r in pieces.folded(df.select("seg"), table, 3).collect()}
    assert whole == got


def test_an_edge_opened_late_is_left_to_the_plain_fold(spark):
    """abc goes before bc, by which alone it can be made; xyz after xy."""
    table = pieces.Table(["<unk>", *"abcxyz", "abc", "bc", "xy", "xyz"], [0.0, *[-900.0 - i for i in range(6)], -1.0, -2.0, -3.0, -4.0], [2] + [1] * 10, False, False)
    got = {x.seg: x.ids for x in pieces.folded(spark.createDataFrame([(w,) for w in ("abc", "bc", "bcxyz", "xyzabc")], "seg string"), table, 3).collect()}
    assert got == {"abc": None, "bc": [8], "bcxyz": [8, 10], "xyzabc": None} and pieces.Coder(table).fold("xyzabc") == [10, 7]


def test_ranked_lattice_equals_the_plain_fold(spark):
    """Ranks in random order, so that merges open the way for edges gone by; and characters that are no piece."""
    r = random.Random(8)
    for _ in range(3):
        names = list(dict.fromkeys("".join(r.choice("abc") for _ in range(r.randrange(2, 5))) for _ in range(40)))
        table = pieces.Table(["<unk>", *"ab", *names], [0.0, -900.0, -901.0, *[-float(i) for i in r.sample(range(500), len(names))]], [2] + [1] * (len(names) + 2), False, False)
        coder = pieces.Coder(table)
        words = list({"".join(r.choice("abc") for _ in range(r.randrange(1, 14))) for _ in range(300)})
        got = {x.seg: x.ids for x in pieces.folded(spark.createDataFrame([(w,) for w in words], "seg string"), table, 4).collect()}
        assert len(got) == len(words) and sum(v is not None for v in got.values()) > 100
        assert all(v is None or v == coder.fold(w) for w, v in got.items())


# --- 8

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site head, with words. And more.</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, really. Accept them.</div><article><h1>Big&nbsp;&amp; small</h1><p>First  para,
with <b>bold</b> text.<p>Second &lt;one&gt;. <script>x("</p>")</script><ul><li>item one.</li><li>item two.</ul><aside>Look aside, please.</aside></article>
<section id="comments"><p>I am a comment, and a long one at that. Yes indeed.</p></section><form><p>Sign up, now.</p></form><footer>&copy; me, 2024.</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE) == "Big & small\n\nFirst para, with bold text.\n\nSecond <one>.\n\nitem one.\n\nitem two."


def test_page_without_article():
    body = "".join(f"<p>Sentence {i}, with some words. Another one follows here.</p>" for i in range(5))
    page = f"<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div class=content><h2>Head</h2>{body}</div><div class='side ads'>Buy this, now.</div></body>"
    assert html_text.main_text(page).split("\n\n")[0] == "Head" and html_text.main_text(page).count("Sentence") == 5 and "Buy" not in html_text.main_text(page)


def test_heading_outside_the_text_box():
    body = "<p>A sentence, with words. One more.</p>" * 3
    page = f"<div id=header>Logo, here.</div><div id=content><h1>T</h1><div class=text>{body}</div></div><div id=sidebar>{body}</div>"
    assert html_text.main_text(page).split("\n\n") == ["T"] + ["A sentence, with words. One more."] * 3


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words, no tags."), (4, "u", "<nav>menu</nav>"), (5, "u", "<p>" * 2000 + "deep."), (6, "u", "<a <b <c \"" * 500), (None, "u", PAGE), (1, "u", None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 8 and by[1].text == by[2].text == by[4].text == "" and by[3].text == "plain words, no tags." and by[5].text == "deep."
    assert all(r.n_chars == len(r.text) for r in got)


# --- 9

def test_deobfuscation(spark):
    r = random.Random(3)
    clean = ["river", "mountain", "table", "garden", "window", "bottle", "paper", "silver"]
    rows, labels = [], []
    for i in range(400):
        bad = r.random() < 0.3
        words = [r.choice(clean) for _ in range(20)] + ([r.choice(["idiot", "moron"])] if bad else [])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    hidden = ["the 1d10t river", "m0r0n table paper", "you i d i o t there", "garden idiooooot", "i.d.i.o.t window", "an !diot"]
    fine = ["river 2024 table", "silver a b c d paper", "w1ndow g4rden", ""]
    rows += [(1000 + i, t) for i, t in enumerate(hidden)] + [(2000 + i, t) for i, t in enumerate(fine)] + [(3000, None), (None, "idiot")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(df, lab).collect()}
    assert len(got) == len(rows)
    assert all(got[1000 + i].predicted for i in range(len(hidden))), [t for i, t in enumerate(hidden) if not got[1000 + i].predicted]
    assert not any(got[2000 + i].predicted for i in range(len(fine))) and got[3000].predicted == 0 and got[None].predicted == 1
    assert all(got[i].predicted == y for i, y in labels if got[i].held_out)
    kept = toxicity.keep_clean(df, toxicity.fit(df, lab))
    assert kept.columns == df.columns and kept.count() == sum(1 for x in got.values() if not x.predicted)


def test_toxicity_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, empty).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), empty).count() == 0


# --- 10

def judge(url):
    at = -1 if url is None else url.find("://")
    rest = "" if at < 0 else url[at + 3:]
    for c in "#?":
        rest = rest.split(c)[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[1:]) if fit else (host, path, None, "block" if any(g.strip("*") in host for g in url_filter.HOST_GLOBS) else "allow")


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "http://xcom/", "http://A.Example.COM/en/x?y", "http://www.example.com/en/", "http://www.example.com/e", "//net/fr/", "a://b.net/fr/?q#z", "http://net?/fr/",
            "http://x.casino.org/", "http://é.net/es/ü", "http://com/" + "a" * 5000, "x://com\\/", "http://casino.com/en/", "http://a.net/fr/", "http://a.net/fr/"]
    got = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = judge(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), urls[r.page_id]


def test_globs_match_as_regular_expressions_do():
    import re

    r = random.Random(9)
    globs = ["".join(r.choice("ab*?") for _ in range(r.randrange(1, 14))).encode() for _ in range(40)]
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(12))).encode() for _ in range(200)] + [b""]
    hit = url_filter.Automaton.of(globs).match(texts)
    for j, g in enumerate(globs):
        p = re.compile(re.escape(g).replace(rb"\*", b".*").replace(rb"\?", b"."), re.S)
        assert [bool(p.fullmatch(t)) for t in texts] == hit[:, j].tolist()


def test_a_worker_keeps_its_tokenizer(monkeypatch):
    import public_tokenizers
    import tokenizers
    from riskloom.llm.token_shards import Encoder

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    monkeypatch.setattr(Encoder, "kept", {})
    first = Encoder(spec, 2)
    assert Encoder(spec, 2).tokenizer is first.tokenizer and Encoder(spec, 4).cache is not first.cache
    signs = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0     　"
    texts = [f"a{x}{y}b {x}é c{x}" for x in signs for y in signs + " \n"] + [f"{x} a" for x in signs]
    assert [list(memoryview(x).cast("H")) for x in first(texts)] == [e.ids for e in tokenizers.Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]
