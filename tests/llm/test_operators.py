"""Every operator against brute force, over awkward rows: nulls, empty and long texts, ties, repeats, empty tables."""

import gc
import hashlib
import math
import os
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vacantia.llm import ann, bpe, chat, exact, langid, lines, lm, mixing, queries, secrets, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 9000


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def awkward(n=60, seed=3):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "One"), (4, "one"), (5, "one two"), (6, LONG), (7, "É one"), (8, "é one"), (None, "no id at all")]
    for i in range(10, 10 + n):
        rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))))
    rows += [(100, rows[12][1]), (101, rows[12][1].upper()), (102, rows[13][1] + " tail"), (100, rows[12][1])]
    return rows


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ---- language ID


def texts_of(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]


def test_phrases_match_a_greedy_parse(spark):
    samples = defaultdict(list)
    for _, text, lang in texts_of(spark)[:60]:
        samples[lang].append(text)
    model = langid.Model(dict(samples), 3000)
    streams = []
    for k in model.languages:
        parts = [np.append(model.squeeze([t])[0], np.uint8(langid.GAP)) for t in samples[k]]
        share = max(200, 3000 // len(parts))
        stream = np.concatenate([p[:share] for p in parts])
        if len(stream) < 3000:
            stream = np.concatenate([stream, *(p[share:] for p in parts)])
        streams.append(stream[: model.length].astype(np.uint8).tobytes())
    parts = model.squeeze([t for _, t, _ in texts_of(spark)[60:70]])
    expected = []
    for part in parts:
        row = []
        for stream in streams:
            phrases = 0
            for lo in range(0, len(part), langid.BLOCK):
                block, held = part[lo : lo + langid.BLOCK].astype(np.uint8).tobytes(), b""
                for symbol in block:
                    if held + bytes([symbol]) in stream:
                        held += bytes([symbol])
                    else:
                        phrases, held = phrases + 1, bytes([symbol]) if bytes([symbol]) in stream else b""
                phrases += 1
            row.append(phrases)
        expected.append(row)
    assert model.phrases(parts)[0].tolist() == expected


def test_language_accuracy_and_awkward_texts(spark, make):
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["held_out"] for i in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    docs = make([(0, None), (1, ""), (2, "123 --"), (3, "the words"), (3, "the words"), (4, LONG)])
    model = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), F.lit(True))
    named = collected(langid.predict(docs, model), "doc_id", "lang_pred")
    assert [x for x in named if x[0] < 3] == [(0, "und"), (1, "und"), (2, "und")] and len(named) == 6
    assert langid.keep_known(docs, model).columns == docs.columns and langid.keep_known(docs, model).count() == 3
    nothing = langid.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_a_language_of_one_line_harms_no_other(spark):
    rows = [(i, t, k) for i, t, k in texts_of(spark) if t and any(map(str.isalpha, t))]
    samples = {"rare": ["zu wele okun batha mi"]}
    for i, t, k in rows:
        if i % 2:
            samples.setdefault(k, []).append(t)
    model = langid.Model(samples, 20_000)
    assert model.lengths.min() < 30 and model.lengths.max() == 20_000
    held = [(t, k) for i, t, k in rows if not i % 2 and k]
    named = model.predict([t for t, _ in held] + samples["rare"])[0]
    assert named[-1] == "rare"
    assert sum(a == k for a, (_, k) in zip(named, held)) > 0.97 * len(held)


def test_languages_of_thousands_of_letters():
    """All letters count, also where two languages share a block of them and most are rare."""
    rnd = random.Random(1500)
    letters = {k: [chr(0x4E00 + i) for i in range(a, a + 1500)] for k, a in (("zz_a", 0), ("zz_b", 1500), ("zz_c", 750))}
    word = lambda k, lo, hi: "".join(rnd.choice(letters[k][lo:hi]) for _ in range(rnd.randint(1, 4)))
    text = lambda k, lo=0, hi=1500: " ".join(word(k, lo, hi) for _ in range(60))
    samples = {k: [text(k) for _ in range(60)] for k in letters} | {"en": ["the words of it are plain words and so are these " * 9]}
    model = langid.Model(samples, 20_000)
    assert model.dense < 100 < 2000 < model.width
    for k, lo, hi in (("zz_a", 0, 700), ("zz_b", 800, 1500)):  # letters of one language only
        assert set(model.predict([text(k, lo, hi) for _ in range(50)])[0]) == {k}
    assert model.predict(["the words are these"])[0] == ["en"]


def test_one_id_repeated_does_not_swell_the_sample(spark, make):
    rows = [(7, f"text {i} of one id", "en", "x") for i in range(900)] + [(i, "ein anderer text", "de", "x") for i in range(20, 40)]
    model = langid.fit(make(rows), F.lit(True), sample_symbols=2000, sample_docs=50)
    assert model.languages == ["de", "en"] and model.length <= 2000


def test_language_memory_does_not_follow_the_batch():
    """A batch of many texts is judged in pieces; all of its 6.4 MB at once took 44 MB of arrays."""
    rnd = random.Random(11)
    samples = {k: ["".join(rnd.choice(letters) for _ in range(400))] for k, letters in (("a", "abcde "), ("b", "defgh "))}
    model = langid.Model(samples, 400)
    texts = [samples["ab"[i % 2]][0] * 8 for i in range(2000)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        found = [n for _, (names, _, _) in langid.judged(model, batch, "text") for n in names]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == ["ab"[i % 2] for i in range(len(texts))]
    assert peak < 20 << 20


# ---- SimHash


def brute_fingerprint(text):
    words = WORD.findall(low(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_simhash_components(spark, make):
    rows = [r for r in awkward() if r[0] is not None]
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(make(rows)).collect()}
    fps = {(i, brute_fingerprint(t)) for i, t in rows}
    values = sorted({f for _, f in fps})
    comp = brute_components(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    first = {}
    for i, f in fps:
        first[comp[f]] = min(i, first.get(comp[f], i))
    assert got == {(i, f"{f:016x}", first[comp[f]]) for i, f in fps}
    assert simhash.near_duplicates(make(rows).limit(0)).count() == 0


def test_anchors_lose_no_link(spark):
    rnd = random.Random(5)
    fps = {0}
    for _ in range(150):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(rnd.randint(0, 6)):
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    every = [(a, b) for a in signed for b in signed if a < b and near(a, b)]
    assert brute_components(signed, links).keys() == brute_components(signed, every).keys()
    same = lambda c: sorted(map(sorted, (lambda g: [[n for n in c if c[n] == r] for r in g])(set(c.values()))))
    assert same(brute_components(signed, links)) == same(brute_components(signed, every))


def test_a_crowded_anchor_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    fps = [(1 << 62) * (i % 2) + i for i in range(64)]  # many within three bits of each other
    links = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    assert len(set(brute_components(fps, links).values())) == len(set(brute_components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]).values()))


def test_near_duplicates_are_dropped(spark, make):
    docs = make([(1, LONG), (2, LONG + "x"), (3, "a b c d"), (4, None), (5, ""), (None, "q w e"), (6, "r t z u"), (6, "r t z u")])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert collected(kept, "doc_id", "source") == sorted([(1, None), (3, None), (4, None), (None, None), (6, None)], key=repr)


# ---- exact dedup


def test_exact_dedup(spark, make):
    rows = awkward()
    got = collected(exact.exact_dedup(make(rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(low(t).encode()).hexdigest()].append(i)
    expected = []
    for h, ids in groups.items():
        keep, done = max((i for i in ids if i is not None), default=None), False
        for i in ids:
            expected.append((i, keep, len(ids), i == keep and not done, h))
            done |= i == keep
    assert got == sorted(expected, key=repr)
    assert exact.exact_dedup(make(rows).limit(0)).count() == 0


def test_exact_dedup_over_several_filters(spark, make, monkeypatch):
    from vacantia.llm import bloom

    monkeypatch.setattr(bloom, "MOST_WORDS", 16)
    rows = [(i, f"text {i // 3 if i % 3 else i}") for i in range(150)] + [(None, None)]
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact.exact_dedup(make(rows)).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert bloom.segments_for(len(rows)) > 1
    assert got == {(i, max((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids}


# ---- secrets


def test_a_long_run_of_failing_hits_is_scanned_once():
    import time

    began = time.time()
    assert secrets.scan("eyJ" * 200_000, secrets.automaton()) == [] and time.time() - began < 5


def github(body):
    return "ghp_" + body + secrets.crc_base62(body)


def brute_spans(text):
    found = []
    patterns = {
        "assign": r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
    }
    for rank, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def test_secrets(spark, make):
    rnd = random.Random(2)
    bits = ["password", "PassWd", "tokentoken", "secret_key", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "İ", "é", "\n", "==", "x", "toKen", "a" * 23]
    good, bad = github("A" * 30), "ghp_" + "A" * 36
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, f"see {good} or {bad}"), (903, LONG + " token=abcdef " + "f" * 100)]
    for r in secrets.find_secrets(make(rows)).collect():
        text = dict(rows)[r["doc_id"]] or ""
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in secrets.KINDS[:3]] == brute_spans(text)
        assert all(s["value"] == text[s["start"] : s["end"]] for s in r["spans"])
        if r["doc_id"] == 902:
            assert [s["value"] for s in r["spans"]] == [good]
    got = {r["doc_id"]: r for r in queries.op4_secrets(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        spans = brute_spans(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[r["doc_id"]]["n_hex"] == sum(s.startswith("hex") for s in spans)
    assert secrets.find_secrets(make(rows).limit(0)).count() == 0


# ---- BPE


def test_bpe_equals_the_library(spark, make):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    library = Tokenizer.from_file(path)
    rnd = random.Random(1)
    pool = ["a", "e", "t", " ", "  ", "\n", "'s", "'", "<|endoftext|>", "12", "é", "ß", "th", "ing", "\x1c", "\x85", " ", "日本", "🙂", "½", "aaaa"]
    rows = [(i, "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30)))) for i in range(400)] + [(900, None), (901, ""), (902, LONG), (902, LONG)]
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(make(rows), path).collect()}
    assert all(ids[i] == library.encode(t or "", add_special_tokens=False).ids for i, t in rows)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(make(rows), path), path).collect()}
    assert all(back[i] == library.decode(ids[i], skip_special_tokens=False) == (t or "") for i, t in rows)
    digest = {r["doc_id"]: r for r in bpe.digests(make(rows), path).collect()}
    for i, t in rows:
        assert digest[i]["ids_sha256"] == hashlib.sha256(np.array(ids[i], dtype="<u4").tobytes()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and digest[i]["exact"]
    broken = spark.createDataFrame([(1, [0x80 + 100, 200]), (2, None), (3, [50256])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(broken, path).collect()} == {1: library.decode([228, 200], skip_special_tokens=False), 2: "", 3: "<|endoftext|>"}
    assert bpe.digests(make(rows).limit(0), path).count() == 0


def test_words_equal_plain_merging():
    codec = bpe.Codec(*bpe.read_vocabulary(queries.vocabulary_path()))
    rnd = random.Random(4)
    for _ in range(300):
        word = "".join(rnd.choice("aethnioé' ") for _ in range(rnd.randint(1, 24))).encode()
        parts = [next(i for i, r in codec.rank.items() if r < 0 and codec.bytes[codec.offsets[i]] == b and codec.size[i] == 1) for b in word]
        while True:
            ranks = [(codec.joined[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in codec.joined]
            if not ranks:
                break
            _, k = min(ranks)
            parts[k : k + 2] = [codec.joined[parts[k], parts[k + 1]][1]]
        assert codec.encode_word(word) == parts


def test_remembered_words_are_bounded():
    """A codec that meets ever new words keeps some tens of MB of them."""
    codec = bpe.Codec(*bpe.read_vocabulary(queries.vocabulary_path()))
    for i in range(600_000):
        codec._pack(f" {i}")
    held = [codec.words, codec.older, codec.fits]
    assert sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in held) < 80 << 20
    assert codec._pack(" 3") == np.array(codec.encode_word(b" 3"), dtype="<u4").tobytes()


def test_codec_goes_with_its_broadcast(spark, make):
    """A worker that goes on to tasks of another kind holds no codec any more."""

    def codecs(batches):
        for _ in batches:
            pass
        held = sum(isinstance(x, bpe.Codec) for x in gc.get_objects())
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([os.getpid()], pa.int64())], ["held", "worker"])

    rows = make([(i, f"text {i}") for i in range(64)]).repartition(16)
    assert bpe.digests(rows, queries.vocabulary_path()).count() == 64
    found = rows.select("doc_id").mapInArrow(codecs, "held long, worker long").collect()
    assert len(found) == 16 and not any(r["held"] for r in found)


# ---- LM scoring


def test_lm_base_score_and_model(spark, make):
    rows = [r for r in awkward(120) if r[0] is not None]
    got = collected(lm.score(make(rows)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    tokens = [(i, [*WORD.findall(low(t)), "\n"]) for i, t in rows]
    train = [(i, t) for i, t in tokens if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for _, t in train for w in t)
    n, v = sum(c.values()), len(c)
    base = sorted((i, zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tokens)
    for a, b in zip(sorted(got, key=lambda x: x[:6]), base):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
        assert a[6] < 0 and math.isfinite(a[6])
    assert lm.score(make(rows).limit(0)).count() == 0


def test_lm_score_is_the_mixture(spark, make):
    """The model rebuilt by hand: weights from the deleted part, counts of all training texts."""
    rows = [r for r in awkward(150, seed=9) if r[0] is not None and r[0] != 6]
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(make(rows)).collect()}
    tokens = [(zlib.crc32(str(i).encode()) % 10, i, ["<", *WORD.findall(low(t)), ">"]) for i, t in rows]

    def model(keep):
        uni, bi = Counter(), Counter()
        for f, _, t in tokens:
            if keep(f):
                uni.update(t[1:]), bi.update(zip(t, t[1:]))
        context = lambda h: uni[">"] if h == "<" else uni[h]
        n, v = sum(uni.values()), len(uni)
        return lambda h, w: (min(int(math.log2(context(h) + 1)), 23), bi[h, w] / context(h) if context(h) else 0.0, uni[w] / n, 1 / (v + 1))

    early, cells = model(lambda f: f > 1), Counter()
    floor = 0
    for f, _, t in tokens:
        for h, w in zip(t, t[1:]) if f == 1 else ():
            b, p2, p1, floor = early(h, w)
            cells[b, int(lm._cell(np.array(p2))), int(lm._cell(np.array(p1)))] += 1
    weights = lm.learn_weights(np.array([[*k, n] for k, n in sorted(cells.items())]), floor)
    late = model(lambda f: f > 0)
    for _, i, t in tokens:
        total = 0.0
        for h, w in zip(t, t[1:]):
            b, *p = late(h, w)
            total += math.log10(float(weights[b] @ p))
        assert abs(got[i, len(t) - 1] - total) < 1e-6 * max(1, abs(total))


def test_weights_explain_held_out_counts():
    cells = np.array([[3, 10, 40, 900], [3, lm.LOWEST, 40, 50], [5, lm.LOWEST, lm.LOWEST, 7]])
    weights = lm.learn_weights(cells, 1e-6)
    assert np.allclose(weights.sum(1), 1) and weights[3, 0] > 0.8 and weights[5, 2] > 0.8 and (weights > 0).all()


# ---- chats


def test_chats_round_trip(spark):
    rnd = random.Random(6)
    bits = ["<s>", "</s>", "<~s>", "<~~/s>", "<n>", "<~n>", "\n", "a", "é", " ", "[INST]", "<", ">", "~", "</s>\n", "<s>user\n", "<<s>"]
    any_text = lambda: None if rnd.random() < 0.1 else "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "a\nb", "<s>"]), any_text()) for c in range(80) for t in range(rnd.randint(1, 6))]
    rows += [(None, None, "assistant", "x"), (None, 1, "user", "y"), (500, 1, "user", "same"), (500, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    source = defaultdict(list)
    for c, t, r, x in rows:
        source[c].append((t is not None, t or 0, r or "", x or ""))
    out = chat.format_chats(df).collect()
    assert len(out) == len(source)
    for r in out:
        turns = [(role, text) for _, _, role, text in sorted(source[r["conv_id"]])]
        assert r["exact"] and [tuple(t) for t in r["turns"]] == turns
        spans = [r["formatted"][s["start"] : s["end"]] for s in r["loss"]]
        assert [re.sub(r"<~(~*)(/s|s|n)>", r"<\1\2>", s) for s in spans] == [x for role, x in turns if role == "assistant"]
        assert [r["formatted"].encode()[s["first_byte"] : s["end_byte"]].decode() for s in r["loss"]] == spans
        assert r["formatted"].count("</s>") == len(turns)
    assert chat.format_chats(df.limit(0)).count() == 0
    shown = [("user", "r", "é<s>"), ("assistant", "a\nb", "x é"), ("assistant", "", "")]
    placed = spark.createDataFrame([(shown,)], "rows array<struct<role:string,shown_role:string,shown:string>>").select(chat._spans(F.col("rows")).alias("s")).first()["s"]
    whole = "".join(f"<s>{r}\n{t}</s>\n" for _, r, t in shown)
    assert [whole[s["start"] : s["end"]] for s in placed] == [whole.encode()[s["first_byte"] : s["end_byte"]].decode() for s in placed] == [t for _, _, t in shown]
    plain = chat.format_chats(spark.createDataFrame([(1, 0, "user", "no ~ marks < here >")], "conv_id long, turn long, role string, text string")).first()
    assert plain["formatted"] == "<s>user\nno ~ marks < here ></s>\n"


# ---- lines


def test_signatures_equal_plain_minhash():
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(30, 90))) for _ in range(50)]
    together = lines.signatures(texts)
    assert (together == np.concatenate([lines.signatures([t]) for t in texts])).all()
    assert (lines.signatures([texts[0] + texts[0]]) != together[0]).any()


def test_tiles_connect_what_is_similar():
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(200)]
    base = [[rnd.choice(words) for _ in range(40)] for _ in range(6)]
    texts = [" ".join([*b[:n], rnd.choice(words), *b[n + 1 :]]) for b in base for n in range(10)]
    keys, sets, sides = list(range(len(texts))), [lines.shingles(t) for t in texts], [i % 2 for i in range(len(texts))]
    true = [(a, b) for a in keys for b in keys if a < b and lines.similar(sets[a], sets[b])]
    half = [[i for i in keys if i % 2 == k] for k in (0, 1)]
    tiles = lines.similar_links(keys, texts, sides) + [x for h in half for x in lines.similar_links(h, [texts[i] for i in h])]
    assert set(map(tuple, map(sorted, tiles))) <= set(true) and len(true) > 20
    assert brute_components(keys, tiles) == brute_components(keys, true) == brute_components(keys, lines.similar_links(keys, texts))
    assert lines.similar_links([], []) == []


@pytest.mark.parametrize("letters", ["ab", "abcd\u00e9 ", "".join(map(chr, range(32, 290))), "".join(map(chr, range(0x400, 0x700))) + "\U0001f600\ud800"])
def test_shingles_as_numbers_are_the_sets(letters):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(letters, k=rnd.randint(8, 60))) for _ in range(12)]
    texts += [t + "a" for t in texts[:6]] + texts[:2]
    numbers, sets = lines.shingle_sets(texts), [lines.shingles(t) for t in texts]
    assert [len(n) for n in numbers] == [len(s) for s in sets]
    assert all(len(np.intersect1d(m, n)) == len(s & t) for m, s in zip(numbers, sets) for n, t in zip(numbers, sets))


def test_lines_are_deduplicated(spark, make):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    line = lambda n=14: " ".join(rnd.choice(words) for _ in range(n))
    base = [line() for _ in range(40)]
    rows, k = [(0, None), (1, ""), (2, "\n \n"), (3, "short\nshort"), (4, "short")], 10
    for i in range(120):
        picked = [rnd.choice(base) if rnd.random() < 0.5 else line() for _ in range(rnd.randint(1, 5))]
        picked = [p[:-1] + "z" if rnd.random() < 0.3 else p.upper() if rnd.random() < 0.1 else p for p in picked]
        rows.append((k + i, "\n".join(picked)))
    rows += [(900, base[0]), (900, base[0])]
    occurrences = {}
    for i, t in rows:
        for j, n in lines.eligible(t or ""):
            occurrences[i, j] = n
    distinct = sorted(set(occurrences.values()))
    sets = {t: lines.shingles(t) for t in distinct}
    comp = brute_components(distinct, [(a, b) for a in distinct for b in distinct if a < b and lines.similar(sets[a], sets[b])])
    stays = {}
    for at, n in occurrences.items():
        stays[comp[n]] = min(at, stays.get(comp[n], at))
    expected = []
    for i, t in rows:
        left = [x for j, x in enumerate((t or "").split("\n")) if (i, j) not in occurrences or stays[comp[occurrences[i, j]]] == (i, j)]
        lost = t is not None and len(left) < len(t.split("\n"))
        if not lost or any(x.strip() for x in left):
            expected.append((i, t if t is None else "\n".join(left)))
    docs = make(rows)
    got = lines.dedup_lines(docs)
    assert got.columns == docs.columns and collected(got, "doc_id", "text") == sorted(expected, key=repr)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_short_lines_are_deduplicated_too(spark, make):
    near = "abcdefghijklmnopqrstuvwxyz"
    docs = make([(1, "And ornd.\n}\n\n" + near), (2, "}\nkept\n\nand  ORND."), (3, near + "z\n \n}\nkept"), (4, "abcdefg"), (5, "abcdefgh"), (6, "}")])
    assert collected(lines.dedup_lines(docs), "doc_id", "text") == [(1, "And ornd.\n}\n\n" + near), (2, "kept\n"), (4, "abcdefg"), (5, "abcdefgh")]


def test_rows_of_one_id_or_none_are_told_apart(spark, make):
    near = "the quick brown fox jumps over the lazy dog and then it sleeps"
    unique = lambda k: "".join(random.Random(k).choices("abcdefghij", k=60))
    rows = [(None, unique(1) + "\nsame here"), (None, unique(2) + "\nsame here"), (None, near), (7, unique(3) + "\nalso same"), (7, unique(4) + "\nalso same"), (9, near + "s\n" + unique(5))]
    got = [(r["doc_id"], r["text"]) for r in lines.dedup_lines(make(rows)).collect()]
    assert Counter(x for _, t in got for x in t.split("\n")) == Counter([*map(unique, range(1, 6)), "same here", "also same", near])
    assert sorted(i or 0 for i, _ in got) == [0, 0, 0, 7, 7, 9]


# ---- nearest neighbours


def test_nearest_neighbours(spark):
    got = queries.op9_nearest(spark, SMALL).collect()
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    right = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[list(ids).index(q)]
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        right += len({int(ids[i]) for i in best} & {v for v, _ in found[q]})
        assert len(found[q]) == 20 and all(abs(s - score[list(ids).index(v)]) < 1e-9 for v, s in found[q])
        assert found[q] == sorted(found[q], key=lambda t: (-t[1], t[0]))
    assert right >= 0.9 * 20 * len(found) and len(found) == sum(ids % 20 == 0)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0]), (20, [0.5, 1.0]), (40, [1.0, 0.0]), (41, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("codes", F.lit(1))
    got = collected(ann.search(df, F.col("vec_id") % 20 == 0), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 40, 1.0), (0, 2, 41, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 40, 0.5), (20, 3, 41, 0.5), (40, 1, 0, 1.0), (40, 2, 41, 1.0), (40, 3, 20, 0.5)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize(("n", "kind"), [(2_000, "independent"), (16_384, "independent"), (16_384, "copies")])
def test_recall_over_full_blocks(spark, monkeypatch, n, kind):
    """At least 0.9 of the true 20 nearest, also where a third of the rows are near copies of one."""
    monkeypatch.setattr(ann, "LEAST_BLOCKS", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 64))
    if kind == "copies":
        x[: n // 3] = x[0] + 0.05 * rng.normal(size=(n // 3, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))})).repartition(4)
    found = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % (n // 100) == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    wide, right = x.astype(np.float64), 0
    for q in found:
        score = wide @ wide[q]
        score[q] = -np.inf
        right += len(found[q] & set(np.argsort(-score, kind="stable")[:20].tolist()))
    assert len(found) >= 100 and right >= 0.9 * 20 * len(found), right / 20 / len(found)


def test_beam_search_beats_greedy():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    books = ann.fit(x, books=4, words=16)
    error = lambda beam: float(((x - sum(b[c] for b, c in zip(books, ann.beam_encode(x, books, beam).T))) ** 2).sum())
    assert error(8) <= error(1)


# ---- mixing


def brute_targets(sizes, weights=(3, 1, 2), factor=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    open_, target, left = set(order), {}, factor * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if most * sizes[s] <= level * weight[s]]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, make, seed):
    rnd = random.Random(seed)
    sources = ["b", "a", "é", None, "Z", "z", "empty"]
    rows = []
    for i in range(1500):
        s = rnd.choices(sources, [1, 9, 3, 2, 1, 1, 0])[0]
        rows.append((i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 200])), "en", s))
    rows += [(5000, None, "en", "empty"), (None, "one two", "en", "a"), (7, rows[7][1], "en", rows[7][3])]
    docs = make(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    source_of = {(r[0], len((r[1] or "").split())): r[3] for r in rows}
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    target = brute_targets(sizes)
    taken = Counter()
    for r in got:
        s = source_of[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"] and len(r["shards"]) == r["copies"]
    assert all(abs(taken[s] - target[s]) <= max(5, 0.01 * target[s]) for s in target)
    assert collected(mixing.mix(docs), "doc_id", "taken", "shards") == sorted([(r["doc_id"], r["taken"], r["shards"]) for r in got], key=repr)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_splitting_tree_keeps_quotas():
    counts = [1000, 3, 0, 250]
    quotas = mixing.split(counts, 8, 1)
    assert quotas.sum(0).tolist() == counts and (quotas >= 0).all() and np.ptp(quotas.sum(1)) <= 1
    draws = np.array([mixing.split(counts, 2, seed)[0, 0] for seed in range(300)])
    total = sum(counts)
    assert abs(draws.mean() - 1000 * (total // 2) / total) < 1.5


def test_near_copies_of_one_id_are_told_apart(spark, make):
    a, b = LONG, " ".join(f"w{i}" for i in range(300))
    kept = simhash.drop_near_duplicates(make([(1, a), (2, b), (2, a), (None, b + " x"), (None, "p q r s")]))
    assert sorted((r["doc_id"] or -1, r["text"][:5]) for r in kept.collect()) == [(-1, "p q r"), (1, a[:5]), (2, b[:5])]


def test_rows_of_one_id_lose_only_their_own_lines(spark, make):
    one, two = "a line that stands in two of the rows", "a unique line of another text here"
    got = collected(lines.dedup_lines(make([(1, one), (2, one), (2, two)])), "doc_id", "text")
    assert got == [(1, one), (2, two)]
