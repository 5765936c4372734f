"""The registered queries and the pipeline's stages against brute force, over whole tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_operators import LONG, WORD, brute_components, brute_fingerprint, brute_targets, low
from vacantia.llm import langid, lines, mixing, queries


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def brute_line_dedup(rows):
    """(id, text) rows as they are left; rows with one id and one text count as one document."""
    seats = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    occurrences = [(seat, i, n) for seat in seats for i, n in lines.eligible(seat[1] or "")]
    distinct = sorted({n for _, _, n in occurrences}, key=len)
    sets = {n: lines.shingles(n) for n in distinct}
    links = []
    for a, one in enumerate(distinct):
        for two in distinct[a + 1 :]:
            if len(sets[one]) < lines.SIMILARITY * len(sets[two]) and len(two) > 2 * len(one) + 20:
                break
            if lines.similar(sets[one], sets[two]):
                links.append((one, two))
    groups = brute_components(distinct, links)
    return occurrences, groups


def assert_line_dedup(before, after):
    """One line of each group stays, none is lost, and what else there was is untouched."""
    occurrences, groups = brute_line_dedup(before)
    left = Counter(groups[n] for _, t in set(after) for _, n in lines.eligible(t or ""))
    assert set(left) == {groups[n] for _, _, n in occurrences} and set(left.values()) == {1}


def test_simhash_query(spark, docs):
    got = {r["doc_id"]: r for r in queries.op2_simhash(spark, SMALL).collect()}
    fps = {i: brute_fingerprint(r["text"]) for i, r in docs.items()}
    values = sorted(set(fps.values()))
    component = brute_components(values, [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 3])
    first = {}
    for i, f in fps.items():
        first[component[f]] = min(i, first.get(component[f], i))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f:016x}", first[component[f]]) for i, f in fps.items()}


def test_bpe_query(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    for r in queries.op5_bpe(spark, SMALL).collect():
        text = docs[r["doc_id"]]["text"] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_lm_query(spark, docs):
    tokens = {i: [*WORD.findall(low(r["text"])), "\n"] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = queries.op6_lm_score(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0


def test_line_dedup_query(spark, docs):
    got = queries.op8_line_dedup(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    for r in got:
        text = texts[r["doc_id"]]
        assert r["text_sha256"] == (None if text is None else hashlib.sha256(text.encode()).hexdigest())
        assert r["n_left"] == (None if text is None else len(text)) and r["n_chars"] == docs[r["doc_id"]]["n_chars"]
        assert text is None or r["n_lines"] == text.count("\n") + 1
    assert_line_dedup([(i, r["text"]) for i, r in docs.items()], [(i, t) for i, t in texts.items()])


def test_mixing_query(spark, docs):
    got = queries.op10_mixing(spark, SMALL).collect()
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in docs.items()}
    sizes, taken = Counter(), Counter()
    for i, r in docs.items():
        sizes[r["source"]] += size[i]
    target = brute_targets(sizes)
    for r in got:
        source = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[source]) and abs(r["target"] - target[source]) < 1e-6 * max(1, target[source])
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["shards"]) == (r["taken"] // r["size"] if r["size"] else 0)
        taken[source] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(60, 0.12 * target[s]) for s in target)


def test_pipeline_stages_against_brute_force(spark, docs, make):
    """Each stage on all that its predecessor kept, among them rows without text or id, with one id, copies and a long text."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.values()][:90]
    plain = rows[3][1]
    rows += [(None, "no id at all but words enough to be read", "en", "x"), (7, "another text under an id that repeats itself", "en", "x"), (7, "another text under an id that repeats itself", "en", "x"), (901, None, "en", None), (902, "", None, "y"), (903, LONG, "en", "y"), (904, plain, "en", None), (905, "123 --", "en", "y")]
    current = make(rows)
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        out = stages[name](spark, current, SMALL)
        assert name == "BPE encoding" or out.schema.names == current.schema.names
        written = [tuple(r) for r in out.collect()]
        return written, (spark.createDataFrame(written, current.schema) if name != "BPE encoding" else out)

    kept, current = step("language ID")
    model = langid.fit(make(rows), corpus_pipeline.remainder(corpus_pipeline.F.col("doc_id"), 5) != 0)
    named = model.predict([r[1] for r in rows])[0]
    assert Counter((r[0], r[1]) for r in kept) == Counter((r[0], r[1]) for r, k in zip(rows, named) if k != langid.UNKNOWN)
    before = [(r[0], r[1]) for r in kept]
    kept, current = step("line dedup")
    assert_line_dedup(before, [(r[0], r[1]) for r in kept])
    before = [(r[0], r[1]) for r in kept]
    kept, current = step("SimHash near-dedup")
    fps = {t: brute_fingerprint(t) for _, t in before}
    values = sorted(set(fps.values()))
    component = brute_components(values, [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in before:
        least[component[fps[t]]] = min(((i is None, i or 0)), least.get(component[fps[t]], (True, math.inf)))
    assert sorted((component[fps[r[1]]], (r[0] is None, r[0] or 0)) for r in kept) == sorted(least.items())
    before, shown = kept, Counter()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(current).collect()}
    kept, current = step("mixing sources")
    expected = Counter()
    for r in before:  # rows that share an id are taken alike
        expected[r[0]] += copies[r[0]]
    assert Counter(r[0] for r in kept) == +expected
    encoded, _ = step("BPE encoding")
    shown = Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in kept)
    assert Counter(r[3] for r in encoded) == shown and all(r[4] for r in encoded)


def test_pipeline_of_nothing_to_keep(spark, make):
    """A table whose rows all go leaves every later stage with none."""
    current = make([(1, None), (2, ""), (3, "12 34")])
    for _, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, SMALL)
    assert current.count() == 0
