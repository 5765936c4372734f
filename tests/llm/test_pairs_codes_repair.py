"""Conversation repair, Jaccard join and vector codes against SQL and brute force, over given tables and awkward rows."""

import itertools
import random

import duckdb
import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm.test_operators import LONG, WORD, brute_components, low
from tests.oracle import compare, connection
from vacantia.llm import codes, jaccard, queries, repair


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    same, what = compare(queries.QUERIES[name](spark, SMALL), connection(SMALL), queries.ORACLE_SQL[name])
    assert same, what


def beside(tmp_path, spark, name, rows, schema, query):
    """The registered query and its SQL on a table of these rows."""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    same, what = compare(queries.QUERIES[query](spark, str(tmp_path)), con, queries.ORACLE_SQL[query])
    assert same, what
    return what


# ---- conversation repair

TURNS = "conv_id long, turn long, role string, text string, present int, fault string"


def talk(rnd, conv, n):
    for i in range(n):
        yield conv, rnd.choice([i, i, i, i + 1, None]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(["a.", "b!", "b", "", " \n", "yes?\x0b ", None, f"text {i}.", "é", "{'x': 1}."]), 5, "x"


def test_awkward_conversations_against_sql(spark, tmp_path):
    rnd = random.Random(11)
    rows = [r for conv in [*range(150), None] for r in talk(rnd, conv, rnd.randint(1, 9))]
    rows += [(500, 0, "user", LONG, 1, ""), (500, 1, "assistant", LONG + ".", 1, ""), *[(501, 3, "user", "Same.", 1, "")] * 4]
    beside(tmp_path, spark, "conversations", rows, TURNS, "op11_conversation_repair")


def brute_repair(rows):
    """Least (cost, letters) over all rows by a table filled from the end."""
    n = len(rows)
    best = {(n, repair.START): (0, ""), (n, repair.ASSISTANT): (0, ""), (n, repair.USER): (5, "I"), (n, repair.SYSTEM): (10, "II")}
    for i in range(n - 1, -1, -1):
        row, here = rows[i], {}
        for state in repair.STATES:
            ways = [(best[i + 1, state][0] + 2, "D" + best[i + 1, state][1])]
            if row.fault not in (1, 2):
                more = 5 if row.fault == 3 else 0
                c, a = best[i + 1, repair.DUE[state]]
                ways.append((c + more + 1, "R" + a))
                if (to := repair.AFTER.get((state, row.initial))) is not None:
                    c, a = best[i + 1, to]
                    ways.append((c + more, "K" + a))
            here[state] = min(ways)
        for state in repair.STATES:
            c, a = here[repair.DUE[state]]
            best[i, state] = min(here[state], (c + 5, "I" + a))
    return best[0, repair.START]


def some_rows(rnd, n):
    return [repair.Row(rnd.choice(["user", "assistant", "system", "x", ""]), "t", rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_search_against_a_whole_table():
    rnd = random.Random(5)
    for n in [*range(9)] * 40 + [60, 120, 256]:
        rows = some_rows(rnd, n)
        assert repair.search(rows, repair.START, repair.ENDS) == brute_repair(rows)


def test_blocks_give_what_one_search_gives(monkeypatch):
    rnd = random.Random(6)
    for block, n in itertools.product([1, 2, 3, 7], [0, 1, 2, 5, 13, 29]):
        monkeypatch.setattr(repair, "BLOCK", block)
        for _ in range(6):
            rows, out = some_rows(rnd, n), []
            c = repair.Conversation(out.extend)
            for row in rows:
                c.add(None, row)
            c.end()
            assert (c.cost, "".join(c.letters)) == brute_repair(rows)
            assert out == repair.replay(rows, "".join(c.letters), repair.START)[0]


def test_repaired_turns_and_nothing(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "Hi."), (1, 2, "user", "Ho."), (2, 0, "user", " ")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repair(rows).orderBy("conv_id", "position").collect()] == [(1, 0, "user", "Hi.", "R"), (1, 1, "assistant", "Ho.", "R")]
    assert repair.repair(rows.limit(0)).count() == 0 and repair.report(rows.limit(0)).count() == 0


# ---- Jaccard join


def brute_sets(text):
    words = WORD.findall(low(text))
    return {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute_join(rows):
    sets = [brute_sets(t) for _, t in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 85 * len(a | b)]
    groups = brute_components(range(len(rows)), links)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[groups[i]] = min(doc, least.get(groups[i], doc))
    return sorted(((doc, len(sets[i]), least.get(groups[i]) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def joined(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def variants(rnd, base, n, edits):
    for _ in range(n):
        words = base.split()
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        yield " ".join(words)


def test_join_of_awkward_rows(spark, make):
    rnd = random.Random(12)
    vocabulary = [f"v{i}" for i in range(400)]
    say = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    texts = [None, "", " \n", "one", "One", "one two three", "one  two\tthree", LONG, LONG + "tail", *[say(rnd.randint(1, 12)) for _ in range(40)]]
    for size, edits in ((12, 1), (40, 2), (90, 5), (300, 8)):
        texts += variants(rnd, say(size), 30, edits)
    shared = say(60)
    texts += [f"{shared} {say(rnd.randint(5, 40))}" for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "no id at all but some words of it"), (None, texts[60]), (3, texts[60]), (5, texts[5]), (5, texts[5])]
    assert joined(jaccard.jaccard_join(make(rows))) == brute_join(rows)
    assert jaccard.jaccard_join(make(rows).limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [1, 3])
def test_join_where_most_tokens_are_frequent(spark, make, monkeypatch, frequent):
    """Pairs of frequent tokens, tiles of few sets, and buckets that first links leave open."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "CROWDED", 8)
    rnd = random.Random(frequent)
    base = " ".join(f"b{i}" for i in range(70))
    rows = list(enumerate([*variants(rnd, base, 90, 6), *variants(rnd, base + " " + base[:60], 40, 4), *variants(rnd, " ".join(f"c{i}" for i in range(400)), 40, 30)]))
    assert joined(jaccard.jaccard_join(make(rows))) == brute_join(rows)


def test_similar_sets_share_a_signature():
    rnd = np.random.default_rng(3)
    frequent = np.zeros(jaccard.COUNTERS, dtype=bool)
    frequent[rnd.random(jaccard.COUNTERS) < 0.7] = True
    for n in (6, 7, 13, 14, 31, 32, 60, 64, 250, 1023, 1024, 3000):
        for _ in range(20):
            a = np.unique(rnd.integers(-(1 << 62), 1 << 62, n))
            spare = int(n * 0.15 / 1.85)
            b = np.unique(np.concatenate([rnd.permutation(a)[spare:], rnd.integers(-(1 << 62), 1 << 62, spare)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert len(np.intersect1d(jaccard.signatures(a, frequent)[0], jaccard.signatures(b, frequent)[0]))
                x, y = (np.frombuffer(jaccard.bitmap(t), dtype=np.uint64)[None] for t in (a, b))
                words = min(x.shape[1], y.shape[1])
                assert jaccard.most_shared(jaccard.fold(x, words), jaccard.fold(y, words), len(a), len(b))[0] >= both


# ---- vector codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long"


def test_codes_of_awkward_vectors_against_sql(spark, tmp_path):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.integers(-3, 4, 8) / 1024 * rnd.integers(1, 300)], rnd.choice([1, 2, None]), "c", 1) for i in range(400)]
    rows += [(900, None, 1, "", 0), (901, [0.0, None, *[1.0] * 6], 1, "", 0), (902, [float("nan"), *[1.0] * 7], 1, "", 0), (903, [float("inf"), *[1.0] * 7], 2, "", 0), (904, [], 2, "", 0), (905, [0.0] * 8, None, "", 0), *[(910 + i, [0.125] * 8, 3, "", 0) for i in range(30)]]
    rows = [(i, v, None if k is None else int(k), c, e) for i, v, k, c, e in rows]
    beside(tmp_path, spark, "embeddings", rows, VECTORS, "op13_vector_codes")


def test_few_vectors_repeated_ids_and_none(spark):
    rows = spark.createDataFrame([(1, [0.5] * 4, 1, "", 0), (1, [0.5] * 4, 1, "", 0), (None, [-0.5] * 4, None, "", 0)], VECTORS)
    coded, books = codes.compress(rows)
    assert books.shape == (4, 3, 1) and sorted((r["code"] for r in coded.collect())) == [[0] * 4, [0] * 4, [2] * 4]
    coded, books = codes.compress(rows.limit(0))
    assert coded.count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [0.5] * 4, 1, "", 0), (2, [0.5] * 8, 1, "", 0)], VECTORS))


def test_grid_finds_the_nearest(monkeypatch):
    monkeypatch.setattr(codes, "MEMO", 50)  # cells are forgotten and found again
    rnd = np.random.default_rng(4)
    for width, spread in ((1, 40), (3, 900), (16, 130)):
        book, x = rnd.integers(-spread, spread, (64, width)), rnd.integers(-spread, spread, (1500, width))
        book[7] = book[3]
        grid = codes.Grid(book)
        for _ in range(2):
            index, distance = grid.nearest(x)
            d = ((x[:, None, :] - book[None]) ** 2).sum(-1)
            assert (index == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_long_conversations_of_one_kind_are_searched_quickly():
    for roles, fault in ((["user"], 0), (["user", "assistant", "assistant"], 3), (["x"], 3), (["system", "user"], 0), (["assistant", "user"], 1)):
        rows = [repair.Row(roles[i % len(roles)], "t", fault if i % 2 else 0) for i in range(repair.BLOCK)]
        assert repair.search(rows, repair.START, repair.ENDS) == brute_repair(rows)
